"""Connected components of an edge table, by alternating stars over stored tables.

Each task first turns its edges into a spanning forest of stars. Then each round points
every node at the smallest node it sees, first its larger neighbours, then its smaller
ones, until every edge leads to the smallest node of its component. A node with very many
edges is reduced on the map side; the joins back to the edges read stored tables on both
sides, so that the adaptive rules can split a hot node. Nothing is collected but one
count a round. Each step is a job that the driver plans and remembers, so none is run on
edges that are stars already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.session import materialize

#: Edges that a task turns into stars at a time.
RUN = 1 << 20


def _forests(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) as stars (hi, lo) around the smallest node, of each ``RUN`` edges of a partition."""
    kind = pa.schema([("hi", pa.int64()), ("lo", pa.int64())])

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([batch[c].to_numpy() for batch in held]) for c in "ab"]
        node, at = np.unique(np.stack(ends), return_inverse=True)
        root = local_roots(len(node), *at.reshape(2, -1))
        moved = np.flatnonzero(root != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], schema=kind)

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= RUN:
                yield stars(held)
                held, rows = [], 0
        if rows:
            yield stars(held)

    return edges.mapInArrow(forest, "hi long, lo long")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each ``hi`` has one ``lo``, which has none itself."""
    one, none = F.lit(1), F.lit(0)
    seen = edges.select(F.col("hi").alias("u"), one.alias("up"), none.alias("down")).union(edges.select("lo", none, one))
    found = seen.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not found.filter(F.col("up") > F.when(F.col("down") > 0, 0).otherwise(1)).agg(F.count("*")).head()[0]


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs to rows (node, root): the smallest node reachable.

    Nodes without an edge to another node, and roots themselves, have no row.
    """
    linked = edges.filter(F.col("a") != F.col("b")).select("a", "b")
    cur = materialize(_forests(linked).distinct(), "edges")
    while not _are_stars(cur):
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(cur.select("lo", "hi"))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lows")
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(
            F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialize(large.distinct(), "large-star")
        low = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), "lows")
        small = large.join(low, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        cur = materialize(small.union(low.select("hi", "m")).distinct(), "edges")
    return cur.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def local_roots(n: int, a, b):
    """Within one task: for n items and links a-b (index arrays), each item's smallest reachable index."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
