"""Near-duplicate groups by 64-bit SimHash fingerprints and sharded BK-trees.

Fingerprints within ``RADIUS`` differing bits are linked. Cut into ``BLOCKS``
blocks of bits, two such fingerprints agree in at least ``BLOCKS - RADIUS`` of
them, so each distinct fingerprint is put into one shard for every choice of that
many blocks; linked fingerprints always meet. Each shard holds a BK-tree, whose
children are keyed by their Hamming distance to the parent; a query follows only
the edges within the radius of its own distance. A shard above ``SHARD_ROWS`` is
cut into parts, and each pair of parts is a tree and its queries. Trees travel to
their queries by the shuffle, not by broadcast: the fingerprints of a corpus have
no size bound, and must not go through the driver.

A task turns the links it finds into a spanning forest, so a group of n
fingerprints never becomes n * n rows.

``near_copies`` removes near copies by text: two texts are linked if their sets of five-word
shingles have a Jaccard similarity of ``SIMILARITY`` or more, and groups are what links connect.
Candidates share one of ``BANDS`` keys, each of ``DEEP`` minima of the set under as many orders (of
two texts at the similarity two in a million share none, of more alike ones fewer). What texts
share a key is a bucket. Copies of one text would make every pair of a bucket a candidate; so
for ``ROUNDS`` rounds, or until one links nothing, each text is compared with one text of the largest
group that its buckets hold, and only then all pairs that are not yet of one group. No text crowds out another.

``near_links`` gives the pairs whose fingerprints of single words are within ``WIDE`` bits and those
of five words within ``FAR``.

Null texts are empty. A text without words has fingerprint zero and links like
any other. Null identifiers take part and never are the smallest one unless all
of a group are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.components import components, local_roots
from docketlake.session import materialize

RADIUS = 4
BLOCKS = 6
SHARD_ROWS = 8192
SHINGLE = 4
SEED = 42
#: Near copies by text: bits and blocks for single-word fingerprints, words of a shingle, bits that
#: their fingerprints may differ in, and how alike two sets are.
WIDE, WIDE_BLOCKS, WORDS, FAR, SIMILARITY = 5, 8, 5, 20, 0.8
#: Keys of a text by minima of its shingles, minima of a key, and rounds before all pairs are compared.
BANDS, DEEP, ROUNDS = 25, 4, 3
#: Odd factors that put 64-bit hashes into as many orders, and hashes that are put into them at a time.
ORDERS = np.random.default_rng(SEED).integers(0, 1 << 64, (BANDS * DEEP, 1), np.uint64) | np.uint64(1)
RUN = 1024
#: Shingles of the texts that a task compares with one another.
CELL = 4_000_000
#: Pairs of query and node that a task holds at a time.
FRONTIER = 2_000_000


# --- fingerprints --------------------------------------------------------------


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text in UTF-8, as an unsigned number."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII white-space characters
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join, ones = xxhash.xxh64_intdigest, b" ".join, np.zeros(64, np.int64)
    n = len(words) - shingle + 1
    for at in range(0, n, 1 << 16):
        run = words[at : at + (1 << 16) + shingle - 1]
        hashes = [digest(join(s), SEED) for s in zip(*[run[k:] for k in range(shingle)])]
        octets = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str | Column, shingle: int = SHINGLE) -> Column:
    """A text column's fingerprints, as signed longs of the same bits."""
    @F.arrow_udf("long")
    def bits(texts: pa.Array) -> pa.Array:
        rows = pc.fill_null(texts, "").cast(pa.binary())
        return pa.array(np.array([simhash(row.as_py(), shingle) for row in rows], np.uint64).view(np.int64))
    return bits(text)


# --- shards --------------------------------------------------------------------


def shard_keys(fp: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """One long per choice of blocks that may be free of differences."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
             for lo, hi in zip(edges, edges[1:])]
    return F.array(*[F.xxhash64(F.lit(k), *choice)
                     for k, choice in enumerate(combinations(parts, blocks - radius))])


def cells(fps: DataFrame, radius: int, blocks: int, limit: int) -> DataFrame:
    """Rows (cell, query, and those of ``fps``): the trees' and the queries' fingerprints (fp) of each cell.

    A shard of up to ``limit`` rows is one cell, a tree that is queried with its own
    rows. A larger one has a cell for each pair of its parts.
    """
    shards = materialize(fps.select("*", F.explode(shard_keys(F.col("fp"), radius, blocks)).alias("shard")), "shards")
    crowded = shards.groupBy("shard").count().filter(F.col("count") > limit).select(
        F.col("shard").alias("s"), F.ceil(F.col("count") / limit).cast("int").alias("n"))
    rows = shards.join(materialize(crowded, "crowded-shards"), F.col("shard") == F.col("s"), "left")
    n = F.coalesce("n", F.lit(1))
    rows = rows.select("shard", *fps.columns, n.alias("n"), F.pmod(F.xxhash64("fp", F.lit(1)), n).cast("int").alias("own"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return rows.select("shard", *fps.columns, "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")).select(
        F.xxhash64("shard", low, high).alias("cell"), *fps.columns, (F.col("own") > F.col("other")).alias("query"))


class Forest:
    """The BK-trees of many cells, built level by level over arrays."""

    def __init__(self, fps: np.ndarray, cell: np.ndarray):
        """fps: distinct within a cell; cell: their cells' numbers, ascending."""
        self.fps = fps
        self.root = np.searchsorted(cell, np.arange(cell[-1] + 1 if len(cell) else 0))
        at = self.root[cell]
        waiting = np.flatnonzero(at != np.arange(len(fps)))
        at, keys, children = at[waiting], [], []
        while len(waiting):
            key = at << 7 | np.bitwise_count(fps[waiting] ^ fps[at]).astype(np.int64)
            edge, first, back = np.unique(key, return_index=True, return_inverse=True)
            keys.append(edge)
            children.append(waiting[first])
            at = waiting[first][back]
            stay = at != waiting
            waiting, at = waiting[stay], at[stay]
        keys, children = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, children))
        order = np.argsort(keys)
        self.keys, self.children = keys[order], children[order]

    def links(self, queries: np.ndarray, cell: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes (query, node) within the radius, for queries in given cells."""
        q, node, found = np.arange(len(queries)), self.root[cell], []
        while len(q):
            far = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
            hit = far <= radius
            found.append((q[hit], node[hit]))
            first = np.searchsorted(self.keys, node << 7 | np.maximum(far - radius, 0))
            last = np.searchsorted(self.keys, node << 7 | far + radius, side="right")
            n = last - first
            ends = np.cumsum(n)
            take = np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            q, node = np.repeat(q, n), self.children[take]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (q, q)


def _found(cell: np.ndarray, fp: np.ndarray, query: np.ndarray, radius: int):
    """The links within whole cells in slices, as index pairs (query, node)."""
    cell = np.unique(cell, return_inverse=True)[1]
    sizes = np.bincount(cell)
    own = np.bincount(cell, query == 0, len(sizes)).astype(np.int64)
    use = np.flatnonzero((sizes[cell] > 1) & (own[cell] > 0))
    if not len(use):
        return
    order = use[np.lexsort((fp[use], query[use], cell[use]))]
    cell, bits, query = np.unique(cell[order], return_inverse=True)[1], fp[order].view(np.uint64), query[order]
    tree = np.flatnonzero(~query)
    forest = Forest(bits[tree], cell[tree])
    # A cell with queries of another part asks for those; its own tree is another cell's.
    mixed = np.bincount(cell, query) > 0
    asks = np.flatnonzero(query | ~mixed[cell])
    work = np.cumsum(np.bincount(cell[tree], minlength=cell[-1] + 1)[cell[asks]])
    start = 0
    while start < len(asks):
        stop = max(start + 1, int(np.searchsorted(work, (work[start - 1] if start else 0) + FRONTIER)))
        part = asks[start:stop]
        q, node = forest.links(bits[part], cell[part], radius)
        yield order[part[q]], order[tree[node]]
        start = stop


def forest_edges(cell: np.ndarray, fp: np.ndarray, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within whole cells, as index pairs."""
    root = np.arange(len(fp))
    for a, b in _found(cell, fp, query, radius):
        root = local_roots(len(fp), root[a], root[b])[root]
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return moved, root[moved]


def near_pairs(
    cell: np.ndarray, fp: np.ndarray, query: np.ndarray, far: np.ndarray, radius: int,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of whole cells whose fingerprints differ, but within the radius, and whose
    second ones (``far``) are within ``FAR`` bits, in blocks.

    Rows of one fingerprint are one node of a tree, and meet the rows of another one by one.
    """
    order = np.lexsort((fp, query, cell))
    cell, fp, query, far = cell[order], fp[order], query[order], far[order].view(np.uint64)
    new = np.ones(len(fp), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (query[1:] != query[:-1]) | (fp[1:] != fp[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(fp)))

    def rows(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of groups, and for each the place of its group."""
        n = size[groups]
        place = np.repeat(np.arange(len(groups)), n)
        return first[groups][place] + np.arange(len(place)) - (np.cumsum(n) - n)[place], place

    for q, node in _found(cell[first], fp[first], query[first], radius):
        other = fp[first[q]] != fp[first[node]]
        a, place = rows(q[other])
        b = node[other][place]
        work = np.cumsum(size[b])
        start = 0
        while start < len(a):
            done = work[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(work, done + FRONTIER)))
            to, at = rows(b[start:stop])
            one = a[start:stop][at]
            near = np.bitwise_count(far[one] ^ far[to]) <= FAR
            yield order[one[near]], order[to[near]]
            start = stop


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, limit: int = SHARD_ROWS) -> DataFrame:
    """Distinct fingerprints (fp) to edges (a, b) that span all links within the radius."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell", 1 << 18):
            fp = table["fp"].to_numpy()
            a, b = forest_edges(table["cell"].to_numpy(), fp, table["query"].to_numpy(), radius)
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], schema=kind)

    spread = cells(fps, radius, blocks, limit).repartition("cell").sortWithinPartitions("cell")
    return spread.mapInArrow(search, "a long, b long")


def near_links(texts: DataFrame, radius: int = WIDE, blocks: int = WIDE_BLOCKS, limit: int = SHARD_ROWS) -> DataFrame:
    """All pairs (a, b) of ``near_pairs`` among texts (node, fp, far), the smaller node first; a pair may repeat."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell", 1 << 18):
            cell, fp, query, far, node = (table[c].to_numpy() for c in ("cell", "fp", "query", "far", "node"))
            for a, b in near_pairs(cell, fp, query, far, radius):
                pairs = np.unique(np.sort(np.stack([node[a], node[b]]), axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=kind)

    spread = cells(texts.select("fp", "node", "far"), radius, blocks, limit).repartition("cell").sortWithinPartitions("cell")
    return spread.mapInArrow(search, "a long, b long")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Batches sorted by ``key``, regrouped so that no value of ``key`` is cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        values = table[key].to_numpy()
        cut = int(np.searchsorted(values, values[-1]))
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut).combine_chunks().to_batches()
        size = len(values) - cut
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


# --- documents -----------------------------------------------------------------


def groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, text_hash, fp, root, component_id), one for each row of ``docs``.

    root: the group's fingerprint; component_id: its smallest doc_id.
    """
    rows = materialize(docs.select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        fingerprint(F.col("text")).alias("fp")), "fingerprints")
    per = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = materialize(components(links(per.select("fp"), radius)), "roots")
    rooted = materialize(per.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    named = materialize(rooted.join(ids, "root").select("fp", "root", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without all but one of each group.

    The one with the smallest doc_id stays, null identifiers last; of several texts
    under that identifier one by hash, of repeated rows one.
    """
    return one_of_each(docs, materialize(groups(docs, radius), "groups"))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay; ``found`` has the root of each row's group (doc_id, text_hash, root)."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = found.groupBy("root").agg(F.min(rank).alias("r")).select(
        F.col("r.doc_id").alias("_id"), F.col("r.text_hash").alias("_hash")).distinct()
    best = materialize(best, "representatives")
    repeated = materialize(found.groupBy("doc_id", "text_hash").count().filter("count > 1").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "repeated-rows")

    def match(side: DataFrame):
        return docs["doc_id"].eqNullSafe(side["_id"]) & (
            F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == side["_hash"])
    kept = docs.join(best, match(best), "left_semi")
    once = kept.join(repeated, match(repeated), "left_anti")
    several = kept.join(repeated, match(repeated), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.union(several)


# --- near copies by text ---------------------------------------------------------


def _set(text: bytes) -> np.ndarray:
    """The distinct ``WORDS``-word shingles of a text, as hashes; of fewer words, the whole sequence."""
    words, digest = text.lower().split(), xxhash.xxh64_intdigest
    n = max(len(words) - WORDS + 1, min(len(words), 1))
    return np.unique(np.fromiter((digest(b" ".join(words[k : k + WORDS]), SEED) for k in range(n)), np.uint64, n))


def shingles(text: str | Column) -> Column:
    """A text column's sets of shingles."""
    @F.arrow_udf("array<long>")
    def sets(texts: pa.Array) -> pa.Array:
        rows = pc.fill_null(texts, "").cast(pa.binary())
        return pa.array([_set(row.as_py()).view(np.int64) for row in rows], pa.list_(pa.int64()))
    return sets(text)


def band_keys(some: np.ndarray) -> list[int]:
    """The keys of a set of hashes, as signed longs; two sets share a key if they share its minima."""
    low = np.full((BANDS * DEEP, 1), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(some), RUN):
        low = np.minimum(low, (some[at : at + RUN] * ORDERS).min(1, keepdims=True))
    keys = [xxhash.xxh64_intdigest(minima.tobytes(), k) for k, minima in enumerate(low.reshape(BANDS, DEEP))]
    return np.array(keys, np.uint64).view(np.int64)


def sketch(text: str | Column) -> Column:
    """A text column's numbers of distinct shingles (n) and their ``band_keys`` (keys)."""
    @F.arrow_udf("struct<n:int,keys:array<long>>")
    def sketches(texts: pa.Array) -> pa.Array:
        sets = [_set(row.as_py()) for row in pc.fill_null(texts, "").cast(pa.binary())]
        keys = pa.array([band_keys(some) for some in sets], pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.array([len(some) for some in sets], pa.int32()), keys], ["n", "keys"])
    return sketches(text)


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) without all but one of each group of near copies.

    Texts are near copies if their shingles have at least that Jaccard similarity; groups are
    what such links connect. Which one stays follows the rule of ``deduplicated``.
    """
    text = F.coalesce("text", F.lit(""))
    digest = [F.xxhash64(text).alias("text_hash"), F.xxhash64(F.lit(1), text).alias("second")]
    rows = materialize(docs.select("doc_id", *digest, sketch(F.col("text")).alias("sketch")), "sketches")
    texts = rows.groupBy("text_hash", "second").agg(
        F.min("doc_id").alias("first"), F.any_value("sketch").alias("sketch"))
    texts = materialize(texts.withColumn("node", F.monotonically_increasing_id()), "distinct-texts")
    keyed = texts.select("node", "sketch.n", F.explode("sketch.keys").alias("key"))
    shared = keyed.groupBy("key").count().filter("count > 1").select("key")
    buckets = materialize(keyed.join(materialize(shared, "shared-keys"), "key", "left_semi"), "buckets")
    some = texts.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "first", "text_hash", "second")
    # One document of each text; its copies hold the same.
    held = docs.select("doc_id", "text", *digest).join(materialize(some, "compared"), ["text_hash", "second"]).filter(
        F.col("doc_id").eqNullSafe(F.col("first"))).dropDuplicates(["node"])
    sets = materialize(held.select("node", shingles("text").alias("set")), "shingles")
    roots = _near_roots(buckets, sets, similarity)
    named = texts.join(roots, "node", "left").select("text_hash", "second", F.coalesce("root", "node").alias("root"))
    whole = rows.join(materialize(named, "named"), ["text_hash", "second"]).select("doc_id", "text_hash", "root")
    return one_of_each(docs, materialize(whole, "groups"))


def _near_roots(buckets: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Rows (node, root) of texts in groups, from buckets (key, node, n) and sets (node, set); see ``components``."""
    buckets = _bounded(buckets, sets, similarity)
    known, found, roots, tested = buckets.withColumn("root", F.col("node")), None, None, None
    for step in range(ROUNDS):
        pairs = _offered(known, step, similarity).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        links = materialize(_alike(pairs, sets, similarity), "near-copies")
        if links.isEmpty():  # groups are as before; all pairs of different ones are compared next
            break
        tested, found = (pairs, links) if tested is None else (tested.union(pairs), found.union(links))
        roots = materialize(components(found), "roots")
        known = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    last = materialize(_apart(known, sets, similarity), "near-copies")
    if roots is not None and last.isEmpty():
        return roots
    return materialize(components(last if found is None else found.union(last)), "roots")


def _bounded(bucket: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Rows of ``bucket`` (key, node, n, ...) with ``held``, the shingles of a text that others of these texts have.

    All others are in no intersection, so texts that hold too few of theirs are near to none and go.
    """
    each = sets.join(bucket.select("node").distinct(), "node", "left_semi").select("node", F.explode("set").alias("shingle"))
    own = each.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("node").alias("node")).filter("texts = 1")
    alone = materialize(own.groupBy("node").agg(F.count("*").alias("alone")), "own-shingles")
    held = F.col("n") - F.coalesce("alone", F.lit(0))
    counted = bucket.drop("held").join(alone, "node", "left").withColumn("held", held).drop("alone")
    return materialize(counted.filter(F.col("held") >= similarity * F.col("n")), "bounded-buckets")


def _possible(side: str, other: str, similarity: float) -> Column:
    """Whether two sets can be so alike, by their sizes and what they hold."""
    most = F.least(f"held{side}", f"held{other}")
    return most >= similarity * (F.col(f"n{side}") + F.col(f"n{other}") - most)


def _largest(known: DataFrame, step: int) -> DataFrame:
    """(key, main, hub, n_hub, held_hub): of buckets with texts of several groups the largest group, and one text of it.

    At first that is the text with the fewest shingles of its own, to which variants of one text are nearest.
    """
    own = (F.col("n") - F.col("held") if step == 0 else F.lit(0)).alias("own")
    first = F.struct(own, F.xxhash64("node", F.lit(step)).alias("order"), "node", "n", "held")
    parts = known.groupBy("key", "root").agg(F.count("*").alias("size"), F.min(first).alias("hub"))
    order = F.struct("size", -F.col("hub.own"), -F.col("root"))
    main = F.max_by(F.struct("root", "hub"), order).alias("main")
    several = parts.groupBy("key").agg(F.count("*").alias("parts"), main).filter("parts > 1")
    return several.select("key", F.col("main.root").alias("main"), F.col("main.hub.node").alias("hub"),
                          F.col("main.hub.n").alias("n_hub"), F.col("main.hub.held").alias("held_hub"))


def _offered(known: DataFrame, step: int, similarity: float) -> DataFrame:
    """Pairs (a, b): each text with one of the largest groups of its buckets, that of most of its keys."""
    met = known.join(materialize(_largest(known, step), "largest"), "key").filter(
        (F.col("root") != F.col("main")) & _possible("", "_hub", similarity))
    shared = met.groupBy("node", "hub").count()
    best = F.max_by("hub", F.struct("count", -F.col("hub")))
    return shared.groupBy(F.col("node").alias("a")).agg(best.alias("b"))


def _apart(known: DataFrame, sets: DataFrame, similarity: float, limit: int | None = None) -> DataFrame:
    """The links (a, b) between groups, among all pairs of texts that share a key; one for each text and other group.

    Texts outside the largest group of a bucket meet all of it, and one another. A bucket's sets are moved
    once, whatever its pairs; one of more than ``limit`` shingles is cut into parts, which meet in pairs.
    """
    limit = limit or CELL
    known = materialize(known, "known")
    for _ in range(2):  # the second count knows fewer texts
        mixed = known.join(materialize(_largest(known, ROUNDS).select("key", "main"), "largest"), "key")
        known = _bounded(mixed.drop("main"), sets, similarity)
    main = materialize(_largest(known, ROUNDS).select("key", "main"), "largest")
    bucket = materialize(known.join(main, "key"), "mixed-buckets")
    outside = F.col("root") != F.col("main")

    def parts(n: Column) -> Column:
        return F.greatest(F.ceil(F.sum(n) / limit), F.lit(1)).cast("int")
    cut = materialize(bucket.groupBy("key").agg(
        parts(F.col("n")).alias("all"), parts(F.when(outside, F.col("n")).otherwise(0)).alias("rest")), "parts")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Rows with a cell for each part of the other side."""
        part = F.pmod(F.xxhash64("node"), F.col(own)).cast("int")
        met = rows.withColumn("own", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        pair = ("own", "other") if own == "all" else ("other", "own")
        return met.select(F.xxhash64("key", *pair).alias("cell"), F.lit(own == "rest").alias("asks"), *bucket.columns)
    rows = bucket.join(cut, "key")
    cells_of = dealt(rows, "all", "rest").union(dealt(rows.filter(outside), "rest", "all")).drop("key")
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell", 1 << 10):
            cell = table["cell"].to_numpy()
            edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            for start, stop in zip(edges, edges[1:]):
                a, b = _between(table.slice(start, stop - start).combine_chunks(), similarity)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=kind)

    spread = cells_of.join(sets, "node").repartition("cell").sortWithinPartitions("cell")
    return spread.mapInArrow(search, "a long, b long").distinct()


def _between(cell: pa.Table, similarity: float) -> tuple[list[int], list[int]]:
    """The links of a cell: of each text that asks, one to each other group."""
    node, n, held, root, main, asks = (cell[c].to_numpy() for c in ("node", "n", "held", "root", "main", "asks"))
    sets = [s.values.to_numpy() for s in cell["set"]]
    there = np.flatnonzero(~asks)
    if not len(there) or len(there) == len(node):
        return [], []
    known, at = np.unique(np.concatenate([sets[i] for i in there]), return_inverse=True)
    ends = np.r_[0, np.cumsum([len(sets[i]) for i in there])]
    found: tuple[list[int], list[int]] = ([], [])
    for x in np.flatnonzero(asks):
        most = np.minimum(held[x], held[there])
        may = (root[there] != root[x]) & ((root[there] == main[there]) | (node[x] < node[there]))
        may &= most >= similarity * (n[x] + n[there] - most)
        if not may.any():
            continue
        has = np.zeros(len(known), bool)
        if len(known):
            place = np.minimum(np.searchsorted(known, sets[x]), len(known) - 1)
            has[place[known[place] == sets[x]]] = True
        both = np.diff(np.r_[0, np.cumsum(has[at])][ends])
        near = there[may & (both >= similarity * (n[x] + n[there] - both))]
        for y in near[np.unique(root[near], return_index=True)[1]]:
            found[0].append(int(node[x]))
            found[1].append(int(node[y]))
    return found


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have that Jaccard similarity."""
    met = pairs
    for side in "ab":
        met = met.join(sets.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}")), side)
    both = F.size(F.array_intersect("set_a", "set_b"))
    return met.filter(both >= similarity * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def _candidates(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts (node, fp, far) to compare: all whose fingerprints are within ``WIDE`` and ``FAR`` bits."""
    left = texts.select(F.col("node").alias("a"), "fp", "far")
    right = texts.select(F.col("node").alias("b"), F.col("fp").alias("fp_b"), F.col("far").alias("far_b"))
    close = F.bit_count(F.col("far").bitwiseXOR(F.col("far_b"))) <= FAR
    same = left.join(right, (F.col("fp") == F.col("fp_b")) & (F.col("a") < F.col("b")) & close).select("a", "b")
    return near_links(texts).unionByName(same).distinct()
