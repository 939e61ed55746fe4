"""Best-fit decreasing packing of token sequences, planned on lengths.

Pieces of one length are interchangeable, and there are at most ``capacity``
lengths. So the driver gets one count per length, never a row per document, and
runs best-fit decreasing on the counts: for each length, longest first, a segment
tree over remaining capacities gives the tightest open bins in logarithmic time,
and whole runs of equal bins are filled at once. The plan says where the i-th
piece of a length goes. Pieces are numbered per length by short runs (length and
a hash bucket), so that a length which most pieces share is not one task. The
packing equals that of best-fit decreasing over single pieces.

A null text is empty and packs as its end token. Rows with equal identifiers are
separate documents. No documents give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketlake.llm.bpe import encoded
from docketlake.session import materialize

CAPACITY = 4096
END_TOKEN = 1
#: Pieces of one length that one task numbers, about.
NUMBERED = 4_000

PIECE = "array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>"


class Capacities:
    """A segment tree over remaining capacities: which of them have open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.leaves, np.int64)

    def add(self, remaining: int, ranges: int) -> None:
        node = self.leaves + remaining
        while node:
            self.open[node] += ranges
            node //= 2

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least ``least`` that has an open bin, or -1."""
        node = self.leaves + least
        if self.open[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node + (not self.open[2 * node])
                return node - self.leaves
            node //= 2
        return -1


def plan(counts: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over (length, count) pairs.

    Returns rows (length, first, last, bin, per_bin, offset): the pieces of that
    length numbered first to last (excluded) go ``per_bin`` each to bins from
    ``bin`` on, from ``offset`` there.
    """
    tree, bins, opened = Capacities(capacity), {}, 0
    placed = []

    def put(remaining: int, start: int, n: int) -> None:
        if remaining and n:
            bins.setdefault(remaining, []).append((start, n))
            tree.add(remaining, 1)

    for length, count in sorted(counts, reverse=True):
        done = 0
        while done < count:
            room = tree.tightest(length)
            if room < 0:
                room, start, n = capacity, opened, -(-(count - done) // (capacity // length))
                opened += n
            else:
                start, n = bins[room].pop()
                tree.add(room, -1)
            each, left = room // length, count - done
            full = min(n, left // each)
            if full:
                placed.append((length, done, done + full * each, start, each, capacity - room))
                put(room - each * length, start, full)
                done, left = done + full * each, left - full * each
            if full < n and left:
                placed.append((length, done, done + left, start + full, each, capacity - room))
                put(room - left * length, start + full, 1)
                done, full = done + left, full + 1
            put(room, start + full, n - full)
    return placed


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """One row per piece of each document: its place in the document, length and checksum."""
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                               ("ids_crc32", pa.int64())]))

    @F.arrow_udf(PIECE)
    def cut(texts: pa.Array) -> pa.Array:
        rows = []
        for ids in encoded(texts, path):
            ids = np.append(ids, END_TOKEN).astype("<u4")
            rows.append([
                {"piece": k, "start": at, "length": len(part), "ids_crc32": zlib.crc32(part.tobytes())}
                for k, at in enumerate(range(0, len(ids), capacity))
                for part in [ids[at : at + capacity]]
            ])
        return pa.array(rows, kind)

    return docs.select(F.col(key), F.explode(cut(F.col("text"))).alias("p")).select(key, "p.*")


def pack(rows: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """``rows`` with columns ``sequence_id`` and ``offset``; ``rows`` has key, piece, start, length.

    ``rows`` is read twice and should be stored. The pieces of one length are numbered in as
    many runs as they need, by hash: a length that most pieces share takes many tasks.
    """
    spark = rows.sparkSession
    counts = [(r["length"], r["count"]) for r in rows.groupBy("length").count().collect()]
    schema = "length long, first long, last long, bin long, per_bin long, offset long"
    steps = spark.createDataFrame(plan(counts, capacity), schema)
    steps = steps.groupBy("length").agg(F.collect_list(
        F.struct("first", "last", "bin", "per_bin", "offset")).alias("steps"))
    runs = max([n for _, n in counts], default=0) // NUMBERED + 1
    run = F.pmod(F.xxhash64(key, "piece", "start", "ids_crc32"), F.lit(runs))
    numbered = rows.withColumn("run", run).withColumn(
        "i", F.row_number().over(W.partitionBy("length", "run").orderBy(key, "piece")) - 1)
    sizes = rows.groupBy("length", run.alias("run")).count()
    before = sizes.select("length", "run", (F.sum("count").over(
        W.partitionBy("length").orderBy("run")) - F.col("count")).alias("before"))
    placed = numbered.join(before, ["length", "run"]).join(F.broadcast(steps), "length")
    i = F.col("i") + F.col("before")
    placed = placed.withColumn("i", i).withColumn("step", F.element_at(F.filter(
        "steps", lambda s: (s["first"] <= F.col("i")) & (F.col("i") < s["last"])), 1))
    nth = F.col("i") - F.col("step.first")
    return placed.select(
        key, "piece", "start", "length", "ids_crc32",
        (F.col("step.bin") + F.floor(nth / F.col("step.per_bin"))).cast("long").alias("sequence_id"),
        (F.col("step.offset") + F.pmod(nth, F.col("step.per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """Documents to packed pieces; the pieces are stored once between the two passes."""
    return pack(materialize(pieces(docs, path, capacity, key), "pieces"), capacity, key)
