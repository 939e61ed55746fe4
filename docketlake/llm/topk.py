"""Exact top-k by integer inner product, over vectors sorted by length.

Components become ``floor(scale * x)``. Candidates are stored by descending
length. The queries go out in bounded blocks, each broadcast to a scan of all
candidates. The longest candidates are scanned first and give every query a
threshold; the rest is pruned against it: a run of candidates whose greatest
length times the query's cannot reach the threshold is skipped, and a single pair
is skipped if the inner product of the leading coordinates after an SVD rotation
plus the product of the residual lengths (Cauchy-Schwarz) cannot. What remains is
computed exactly, so neither the rotation nor its sample affects a result.

Null vectors and those with null or non-finite components take no part. Vectors
of different sizes are compared as if the shorter ended in zeros. A candidate is
every row but those with the query's own identifier; a repeated query row gets its
result again. Scores must fit a long; beyond 2**53 they are summed as integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketlake.llm.vectors import matrix, usable
from docketlake.session import materialize

SCALE = 256
LEADING = 16
#: Queries in one broadcast, and rows from which the rotation is fitted.
QUERY_BLOCK = 1 << 15
ROTATION_ROWS = 4096
#: Candidates and queries compared at a time inside a task.
RUN, STEP = 2048, 1024


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


class Queries:
    """A block of queries with their rotation, lengths and thresholds."""

    def __init__(self, key, own, vectors: np.ndarray, rotation: np.ndarray, k: int, least=None):
        self.key, self.own, self.vectors, self.rotation, self.k = key, own, vectors, rotation, k
        self.length = np.sqrt((vectors ** 2).sum(1))
        self.lead = vectors @ rotation
        self.rest = np.sqrt(np.maximum(self.length ** 2 - (self.lead ** 2).sum(1), 0))
        self.least = np.full(len(key), -np.inf) if least is None else least


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products of integer-valued vectors, as longs."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2.0 ** 53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.array([sum(int(x) * int(y) for x, y in zip(p, q)) for p, q in zip(a, b)], np.int64)


def best(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """(query, id, score) rows to the k best of each query, ties to smaller ids."""
    q, ids, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], ids[keep], score[keep]


def scan(block: Queries, runs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """The best candidates of each query among (ids, vectors) runs, pruned on the way."""
    least, none = block.least.copy(), np.zeros(0, np.int64)
    top = (none, none, none)
    for ids, x in runs:
        length = np.sqrt((x ** 2).sum(1))
        lead = x @ block.rotation
        rest = np.sqrt(np.maximum(length ** 2 - (lead ** 2).sum(1), 0))
        reach = np.flatnonzero(block.length * length.max() * (1 + 1e-9) + 1 >= least)
        found = [top]
        for start in range(0, len(reach), STEP):
            q = reach[start : start + STEP]
            bound = block.lead[q] @ lead.T + np.outer(block.rest[q], rest)
            slack = 1 + 1e-9 * block.length[q] * length.max()
            i, j = np.nonzero(bound + slack[:, None] >= least[q][:, None])
            i = q[i]
            other = ids[j] != block.own[i]
            i, j = i[other], j[other]
            for at in range(0, len(i), 1 << 17):
                a, b = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
                score = exact(block.vectors[a], x[b])
                good = score >= least[a]
                found.append((a[good], ids[b][good], score[good]))
        top = best(found, block.k)
        q, first, n = np.unique(top[0], return_index=True, return_counts=True)
        full = n == block.k
        least[q[full]] = np.maximum(least[q[full]], top[2][first[full] + block.k - 1])
    return top


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, RUN):
            part = batch.slice(start, RUN)
            yield part["id"].to_numpy(), matrix(part["vector"], size)


def search(candidates: DataFrame, block: Broadcast, size: int) -> DataFrame:
    """Rows (q, vec_id, score): each task's best candidates of each query of the block."""
    kind = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = block.value
        q, ids, score = scan(queries, _runs(batches, size))
        yield pa.RecordBatch.from_arrays([pa.array(queries.key[q]), pa.array(ids), pa.array(score)], schema=kind)

    return candidates.mapInArrow(run, "q long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE,
          key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of the query rows of ``vectors`` against all."""
    spark = vectors.sparkSession
    rows = vectors.filter(usable(F.col(vector)) & F.col(key).isNotNull()).select(
        F.col(key).alias("id"), scaled(F.col(vector), scale).alias("vector"), is_query.alias("asks"))
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.withColumn("length", length).repartitionByRange(F.col("length").desc(), "id", F.xxhash64("vector"))
    rows = rows.sortWithinPartitions(F.col("length").desc(), "id").withColumn("band", F.spark_partition_id())
    rows = materialize(rows.withColumn("q", F.monotonically_increasing_id()), "by-length")
    size, n, first = rows.agg(F.max(F.size("vector")), F.count_if("asks"), F.min("band")).head()
    results = []
    if n:
        fit = rows.select("vector").orderBy(F.xxhash64("id")).limit(ROTATION_ROWS).toArrow()
        x = matrix(fit["vector"].combine_chunks(), size)
        rotation = np.linalg.svd(x, full_matrices=False)[2][:LEADING].T.copy()
        blocks = -(-n // QUERY_BLOCK)
        for b in range(blocks):
            asked = rows.filter(F.col("asks") & (F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)).toArrow()
            parts = (asked["q"].to_numpy(), asked["id"].to_numpy(), matrix(asked["vector"].combine_chunks(), size))
            block = Queries(*parts, rotation, k)
            longest = _ranked(materialize(search(
                rows.filter(F.col("band") == first), spark.sparkContext.broadcast(block), size), "first-band"), k)
            least = dict(longest.filter(F.col("rank") == k).select("q", "score").toArrow().to_pandas().to_numpy())
            block.least = np.array([least.get(key, -np.inf) for key in parts[0]], float)
            rest = search(rows.filter(F.col("band") > first), spark.sparkContext.broadcast(block), size)
            results.append(materialize(_ranked(longest.drop("rank").union(rest), k), "top"))
    empty = spark.createDataFrame([], "q long, vec_id long, score long, rank int")
    found = empty
    for part in results:
        found = found.unionByName(part)
    return found.join(rows.filter("asks").select("q", F.col("id").alias("query_id")), "q").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
