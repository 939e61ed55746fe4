"""The trie of conversations by shared beginnings.

Every distinct sequence of first turns is a node. Distinct sequences of turn digests
are put in order over range partitions, so each node's sequences are neighbours. A
task joins the neighbours of its partition by union-find over the edges between them
in descending depth of their longest common prefix: every merge of components makes a
branching node, and the way up to it is filled with the nodes of single turns.

A node that lies within one partition is finished there. The nodes on the way to a
partition's first and last sequence may go on next door: they leave the task as
partial sums under a digest of their turns, are added up, and one small task adds the
sums of children to parents (two ways a partition, whatever the partition holds).

* A turn is its 128-bit digest of role and text; no text is gathered. One conversation's
  digests are one row, 20 bytes a turn, so the bound is Spark's 2 GB for a row, about
  a hundred million turns.
* Equal conversations become one sequence before anything is ordered. The hash over
  their identifiers is taken from ordered pieces that many tasks write.

Null role or text is empty. Rows without conv_id belong to no conversation and are left
out. Equal turns are ordered by the digests of what they hold, and repeated rows are
turns each. An empty table has no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketlake.session import materialize

#: Neighbouring conversations whose first one lends its beginning; most turns it lends, plus one.
GROUP, HEADS = 20, 4
#: Turns that a task orders, about; identifiers in a piece of a digest.
TURNS, PIECE = 500_000, 4096
WORD = r"[^\x20\x09-\x0D]+"

NODE = ("open boolean, key binary, parent_key binary, words long, conv_id long, depth long, parent_conv_id long, "
        "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# --- sequences -------------------------------------------------------------------


def _pair(*columns: Column | str) -> list[Column]:
    """A 128-bit digest as two longs."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]


def conversations(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turns: the digests and word counts in order) of ``turns`` (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one, two = _pair(role, text)
    counted = F.regexp_count(text, F.lit(WORD)).cast("int")
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), one.alias("one"), two.alias("two"), counted.alias("words")).alias("t"))
    first = F.col("conv_id") - F.col("conv_id") % GROUP
    # Dealt by what the next step needs, too.
    return (rows.withColumn("first", first).repartition("first").groupBy("first", "conv_id")
            .agg(F.sort_array(F.collect_list("t")).alias("turns")))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Sequences (conv_id, digests, words): each conversation begins with h turns of the first one
    of its group (all it has, if fewer; none, if there is none) and goes on with its own after
    its first h; h is the crc32 of the identifier modulo ``HEADS``."""
    own = conversations(turns)
    lent = F.when(F.col("conv_id") == F.col("first"), F.slice("turns", 1, HEADS - 1))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    rows = own.withColumns({"lent": F.max(lent).over(Window.partitionBy("first")), "h": h})
    begin = F.when(F.col("lent").isNotNull(), F.slice("lent", F.lit(1), F.col("h")))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    rows = rows.select("conv_id", F.when(begin.isNull(), rest).otherwise(F.concat(begin, rest)).alias("t"))
    return rows.select(
        "conv_id", F.flatten(F.transform("t", lambda t: F.array(t["one"], t["two"]))).alias("digests"),
        F.transform("t", lambda t: t["words"]).alias("words"))


def _ends(rows: DataFrame) -> DataFrame:
    """(p, q, ends_sha256) of ``rows`` (p, q, conv_id): the hash over each group's identifiers in order."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> pa.RecordBatch:
            row = [*key, held[0], ",".join(map(str, held))]
            return pa.RecordBatch.from_pylist([dict(zip(["p", "q", "at", "ids"], row))])
        for batch in batches:
            for p, q, c in zip(*(batch[n].to_pylist() for n in ("p", "q", "conv_id"))):
                if held and (key != (p, q) or len(held) == PIECE):
                    yield out()
                    held.clear()
                key = p, q
                held.append(c)
        if held:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            done = []
            for p, q, ids in zip(*(batch[n].to_pylist() for n in ("p", "q", "ids"))):
                if key == (p, q):
                    sha.update(b"," + ids.encode())
                    continue
                if key:
                    done.append((*key, sha.hexdigest()))
                key, sha = (p, q), hashlib.sha256(ids.encode())
            yield _batch(done, "p long, q long, ends_sha256 string")
        if key:
            yield _batch([(*key, sha.hexdigest())], "p long, q long, ends_sha256 string")

    order = ["p", "q", "conv_id"]
    cut = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        pieces, "p long, q long, at long, ids string")
    return cut.repartition("p", "q").sortWithinPartitions("p", "q", "at").mapInArrow(
        digests, "p long, q long, ends_sha256 string")


ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


# --- one partition's forest --------------------------------------------------------


class Forest:
    """The nodes of sequences in order. Each list has one entry a node; a node that was
    merged into another one has that one as its ``same``."""

    def __init__(self):
        self.conv, self.depth, self.n, self.children, self.leaves = [], [], [], [], []
        self.saved, self.ends, self.words, self.parent, self.same = [], [], [], [], []

    def node(self, conv, depth, n, words, children=0, leaves=0, saved=0, ends=None) -> int:
        for column, value in zip(
            (self.conv, self.depth, self.n, self.words, self.children, self.leaves, self.saved, self.ends,
             self.parent, self.same), (conv, depth, n, words, children, leaves, saved, ends, -1, -1)):
            column.append(value)
        return len(self.conv) - 1

    def finish(self, k: int) -> None:
        """All members of a node are known: count it as a leaf, and what it saves itself."""
        self.leaves[k] = self.leaves[k] if self.children[k] else 1
        self.saved[k] += (self.n[k] - 1) * self.words[k]

    def lifted(self, k: int, depth: int, words: list[int]) -> int:
        """The node at ``depth`` above a node, with the nodes between."""
        while self.depth[k] > depth:
            self.finish(k)
            d = self.depth[k] - 1
            up = self.node(self.conv[k], d, self.n[k], words[d - 1] if d else 0, 1, self.leaves[k], self.saved[k])
            self.parent[k] = up
            k = up
        return k

    def merge(self, a: int, b: int) -> int:
        """Two nodes of the same turns become one."""
        self.same[b] = a
        self.conv[a] = min(self.conv[a], self.conv[b])
        for column in (self.n, self.children, self.leaves, self.saved):
            column[a] += column[b]
        self.ends[a] = self.ends[a] or self.ends[b]
        return a

    def now(self, k: int) -> int:
        while self.same[k] >= 0:
            k = self.same[k]
        return k


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Turns that two sequences of digests begin with together."""
    size = min(len(a), len(b))
    other = np.flatnonzero(a[:size] != b[:size])
    return (int(other[0]) if len(other) else size) // 2


def forest(sequences: list[np.ndarray], words: list[list[int]], firsts: list[int], counts: list[int],
           ends: list[str]) -> tuple[Forest, list[int]]:
    """The nodes of ordered distinct sequences, and each sequence's own node; the root last to be met."""
    trie = Forest()
    leaf = [trie.node(f, len(w), n, w[-1] if w else 0, ends=e) for w, f, n, e in zip(words, firsts, counts, ends)]
    lcp = np.array([common(a, b) for a, b in zip(sequences, sequences[1:])], np.int64)
    group, top = list(range(len(leaf))), list(leaf)

    def find(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    for edge in np.argsort(-lcp, kind="stable").tolist():
        depth, a, b = int(lcp[edge]), find(edge), find(edge + 1)
        group[b] = a  # the smaller index stays, and any member's words serve the way up
        top[a] = trie.merge(trie.lifted(top[a], depth, words[edge]), trie.lifted(top[b], depth, words[edge + 1]))
    root = trie.lifted(top[find(0)], 0, words[0])
    trie.finish(root)
    return trie, leaf


def _keys(sequence: np.ndarray) -> list[bytes]:
    """The digest of each beginning of a sequence."""
    whole = hashlib.blake2b(digest_size=16)
    keys = [whole.digest()]
    for turn in sequence.reshape(-1, 2):
        whole.update(turn.tobytes())
        keys.append(whole.copy().digest())
    return keys


def _nodes(sequences, words, firsts, counts, ends) -> list[tuple]:
    """The rows of ``NODE`` of one partition. Open nodes hold what their closed children add up to."""
    trie, leaf = forest(sequences, words, firsts, counts, ends)
    key: dict[int, bytes] = {}
    for k in {0, len(leaf) - 1}:
        at = leaf[k]
        for name in reversed(_keys(sequences[k])):
            at = trie.now(at)
            key[at] = name
            at = trie.parent[at]
    rows, sums = [], {k: [0, 0, 0] for k in key}
    for k in range(len(trie.conv)):
        if trie.same[k] >= 0 or k in key:
            continue
        parent = trie.now(trie.parent[k])
        if parent in key:
            for at, value in enumerate((1, trie.leaves[k], trie.saved[k])):
                sums[parent][at] += value
        rows.append((False, None, key.get(parent), None, trie.conv[k], trie.depth[k],
                     None if parent in key else trie.conv[parent], trie.n[k], trie.children[k], trie.leaves[k],
                     trie.saved[k], trie.ends[k]))
    for k, name in key.items():
        parent = key[trie.now(trie.parent[k])] if trie.depth[k] else None
        rows.append((True, name, parent, trie.words[k], trie.conv[k], trie.depth[k], None, trie.n[k], *sums[k], trie.ends[k]))
    return rows


def _partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    table = pa.Table.from_batches(held) if held else None
    if table is None or not table.num_rows:
        return
    sequences, words = [], []
    for batch in table.to_batches():
        for name, out in (("digests", sequences), ("words", words)):
            flat, at = batch[name].flatten().to_numpy(), batch[name].offsets.to_numpy()
            parts = np.split(flat, (at[1:-1] - at[0]))
            out.extend(parts if name == "digests" else [p.tolist() for p in parts])
    rows = _nodes(sequences, words, *(table[n].to_pylist() for n in ("first_id", "n", "ends_sha256")))
    for start in range(0, len(rows), 10_000):
        yield _batch(rows[start : start + 10_000], NODE)


# --- the whole trie ------------------------------------------------------------------


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open nodes with the sums of their open children added, parents last."""
    rows = [r for b in batches for r in b.to_pylist()]
    rows.sort(key=lambda r: -r["depth"])
    at = {r["key"]: r for r in rows}
    for r in rows:
        r["n_leaves"] = r["n_leaves"] if r["n_children"] else 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["words"]
        if r["depth"]:
            up = at[r["parent_key"]]
            r["parent_conv_id"] = up["conv_id"]
            up["n_children"] += 1
            for name in ("n_leaves", "saved_tokens"):
                up[name] += r[name]
    names = [f.split()[0] for f in NODE.split(", ")]
    for start in range(0, len(rows), 10_000):
        yield _batch([tuple(r[n] for n in names) for r in rows[start : start + 10_000]], NODE)


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of ``sequences`` (conv_id, digests, words), one row each, in ``COLUMNS``."""
    spark = sequences.sparkSession
    p, q = _pair("digests")
    rows = materialize(sequences.select("conv_id", "digests", "words", p.alias("p"), q.alias("q")), "sequences")
    distinct = rows.groupBy("p", "q", "digests", "words").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("first_id")).join(_ends(rows), ["p", "q"])
    distinct = materialize(distinct.drop("p", "q"), "distinct-sequences")
    turns = distinct.agg(F.sum(F.size("words"))).head()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // TURNS))
    ordered = distinct.repartitionByRange(parts, "digests").sortWithinPartitions("digests")
    nodes = materialize(ordered.mapInArrow(_partition, NODE), "nodes")
    names = [f.split()[0] for f in NODE.split(", ")]
    sums = {n: F.max(n) for n in ("words", "ends_sha256")} | {"conv_id": F.min("conv_id")}
    sums |= {n: F.sum(n) for n in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
    opened = nodes.filter("open").groupBy("key", "parent_key", "depth").agg(*[f.alias(n) for n, f in sums.items()])
    opened = materialize(opened.withColumns({"open": F.lit(True), "parent_conv_id": F.lit(None).cast("long")}).select(*names), "open-nodes")
    opened = materialize(opened.coalesce(1).mapInArrow(_summed, NODE), "open-nodes")
    closed = nodes.filter("NOT open")
    above = opened.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    met = closed.filter(F.col("parent_key").isNotNull()).join(above, "parent_key").withColumn("parent_conv_id", F.col("above"))
    every = opened.select(*COLUMNS).unionByName(met.select(*COLUMNS)).unionByName(
        closed.filter(F.col("parent_key").isNull()).select(*COLUMNS))
    return every.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
