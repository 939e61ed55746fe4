"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped.

Words are told apart by 64-bit hashes. Counting takes two passes over the texts:

1. words: each task sends its distinct words with their counts, in one block per
   shard of the hash range; the merged shards are the vocabulary, a sorted hash
   array that gives each word its number, with the counts beside it;
2. bigrams: the same, with pairs of word numbers. A bigram's shard is chosen by its
   first word, so that what a context needs is summed where its bigrams are; words
   so frequent that a shard would be uneven (known from the first pass) spread over
   all shards, and their sums meet afterwards.

The model is a folder of plain arrays: sorted bigram hashes with counts per shard,
and per word its count, its probability by continuation, its total as a context and
its back-off weight. Workers memory-map them from the shared folder, which must be a
mounted path, and look up all bigrams of a slice of texts at once, sorted, in one
sweep.

Order 2: a text begins after a start mark and ends with an end mark, which is
counted as a token. Unknown words share the mass that discounting the continuation
counts leaves, spread evenly over the vocabulary and one unknown word.

Null texts are empty: the end mark alone. Without learning texts every token has
probability one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.text import Words, slices
from docketlake.session import materialize, shared_folder

#: Bytes of text per shard of the vocabulary and of the bigrams, and entries that a task holds before it sends them.
WORD_BYTES, PAIR_BYTES, HELD = 64 << 20, 16 << 20, 3_000_000
SLICE = 4 << 20
# Hashes of the marks: no word hashes to them but by chance.
START, END = np.uint64(1), np.uint64(2)
MIX = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.zeros(0, np.uint64)
#: Counts above this take eight bytes each.
NARROW = (1 << 32) - 1


# --- tokens --------------------------------------------------------------------


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with each text's end mark, and where texts end in them."""
    words = Words(texts, lower=True)
    digest = xxhash.xxh64_intdigest
    distinct = np.array([digest(w) for w in words.distinct.to_pylist()], np.uint64)
    ends = words.ends + np.arange(1, len(words.ends) + 1)
    out = np.empty(len(words.ids) + len(ends), np.uint64)
    plain = np.ones(len(out), bool)
    plain[ends - 1] = False
    out[ends - 1] = END
    out[plain] = distinct[words.ids] if len(words.ids) else EMPTY
    return out, ends


def before(numbers: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    """Each token's predecessor, the start mark for the first of a text."""
    out = np.empty_like(numbers)
    out[1:] = numbers[:-1]
    out[np.concatenate([[0], ends[:-1]])] = start
    return out


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two word numbers, without collisions below 2**32 words (``_words`` sees to that)."""
    x = (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) * MIX
    return (x ^ x >> np.uint64(32)) * MIX


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where ``wanted`` is in the sorted ``keys``, -1 where it is not."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash: equal ranges of the upper half, in ascending order."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


# --- blocks: sorted keys with counts, compressed for the shuffle -------------------

BLOCK = pa.schema([("shard", pa.int32()), ("size", pa.int64()), ("high", pa.binary()), ("low", pa.binary()),
                   ("counts", pa.binary()), ("wide", pa.bool_())])
BLOCK_DDL = "shard int, size long, high binary, low binary, counts binary, wide boolean"


def narrowed(counts: np.ndarray) -> np.ndarray:
    """Counts in four bytes each where all fit, in eight otherwise."""
    return counts.astype(np.uint64 if len(counts) and counts.max() > NARROW else np.uint32)


def packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values), "zstd", asbytes=True)


def unpacked(data: bytes, kind, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size * np.dtype(kind).itemsize, "zstd"), kind)


def block(shard: int, keys: np.ndarray, counts: np.ndarray) -> dict:
    """Sorted 64-bit keys: the steps of the upper halves, which are small, and the lower halves."""
    high = np.diff(keys >> np.uint64(32), prepend=np.uint64(0)).astype(np.uint32)
    counts = narrowed(counts)
    return {"shard": shard, "size": len(keys), "high": packed(high), "low": packed(keys.astype(np.uint32)),
            "counts": packed(counts), "wide": counts.itemsize == 8}


def opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    high = np.cumsum(unpacked(row["high"], np.uint32, row["size"]), dtype=np.uint64)
    low = unpacked(row["low"], np.uint32, row["size"]).astype(np.uint64)
    counts = unpacked(row["counts"], np.uint64 if row["wide"] else np.uint32, row["size"])
    return high << np.uint64(32) | low, counts.astype(np.int64)


def blocks(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block per shard of sorted keys."""
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys[order], counts[order]
    some, first = np.unique(shard, return_index=True)
    for s, a, b in zip(some.tolist(), first.tolist(), [*first[1:].tolist(), len(shard)]):
        yield pa.RecordBatch.from_pylist([block(s, keys[a:b], counts[a:b])], schema=BLOCK)


class Gathered:
    """A task's keys and counts, merged now and then and sent when there are many."""

    def __init__(self, shard: Callable[[np.ndarray], np.ndarray]):
        self.shard, self.parts, self.size = shard, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > HELD:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        keys, counts = joined(self.parts)
        yield from blocks(self.shard(keys), keys, counts)
        self.parts, self.size = [], 0


def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    return summed(np.concatenate([EMPTY, *[k for k, _ in parts]]), np.concatenate([none, *[c for _, c in parts]]))


# --- the model -------------------------------------------------------------------


def folder(spark) -> str:
    """A new folder that every worker can map: a mounted path, named by the session."""
    root = urlparse(shared_folder(spark))
    if root.scheme not in ("", "file"):
        raise ValueError(f"the model is memory-mapped: spark.checkpoint.dir must be a mounted path, not {root.geturl()}")
    return os.path.join(root.path, f"kneser-ney-{uuid.uuid4().hex}")


def put(path: str, name: str, values: np.ndarray) -> None:
    """Write an array so that it appears whole; a repeated task writes the same again."""
    os.makedirs(path, exist_ok=True)
    part = os.path.join(path, f".{name}.{uuid.uuid4().hex}")
    values.tofile(part)
    os.replace(part, os.path.join(path, name))


def mapped(path: str, name: str, kind) -> np.ndarray:
    file = os.path.join(path, name)
    return np.memmap(file, kind, "r") if os.path.getsize(file) else np.zeros(0, kind)


@dataclass
class Model:
    """What the driver keeps: where the arrays are, and sums.

    offsets: the first word number of each word shard, and at the end how many words.
    shards: bigram shards. total, texts: learning tokens and texts. discounts: for
    counts of 1, 2 and more, of bigrams and of continuations. pairs: distinct bigrams.
    left: how many words have 1, 2 and more predecessors.
    """

    path: str
    offsets: np.ndarray
    shards: int
    total: int = 0
    texts: int = 0
    pairs: int = 0
    discounts: np.ndarray | None = None
    lower: np.ndarray | None = None
    left: np.ndarray | None = None

    @property
    def words(self) -> int:
        return int(self.offsets[-1])

    @property
    def spread_above(self) -> float:
        """First words more frequent than this have their bigrams in all shards."""
        return self.total / (4 * self.shards)

    def shard(self, pairs: np.ndarray, often: np.ndarray) -> np.ndarray:
        """The shard of each pair of word numbers; often: how often its first word occurs."""
        own = pair_hash(pairs >> np.uint64(32), np.uint64(0))
        return shard_of(np.where(often > self.spread_above, pair_hash(pairs, np.uint64(1)), own), self.shards)


@lru_cache(maxsize=512)
def _files(path: str, prefix: str, shard: int, names: tuple) -> list[np.ndarray]:
    first = mapped(path, f"{prefix}-{shard}.{names[0][0]}", names[0][1])

    def wide(name: str) -> type:
        size = os.path.getsize(os.path.join(path, f"{prefix}-{shard}.{name}"))
        return np.uint64 if size == 8 * len(first) else np.uint32
    return [first, *[mapped(path, f"{prefix}-{shard}.{name}", kind or wide(name)) for name, kind in names[1:]]]


WORD_FILES = (("keys", np.uint64), ("counts", np.int64))
WEIGHT_FILES = (("left", np.uint32), ("backoff", np.float32))
PAIR_FILES = (("keys", np.uint64), ("counts", None))


def occupied(cuts: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The shards that have rows, and their rows. A slice of texts meets few of very many shards."""
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, slice(cuts[s], cuts[s + 1])


def look_up(model: Model, hashes: np.ndarray, weights: bool) -> list[np.ndarray]:
    """For sorted hashes: word numbers (``words + 1`` if unknown), counts, and the two weights."""
    number, count = np.full(len(hashes), model.words + 1, np.uint64), np.zeros(len(hashes), np.int64)
    left, backoff = np.zeros(len(hashes)), np.ones(len(hashes))
    shards = len(model.offsets) - 1
    cuts = np.searchsorted(shard_of(hashes, shards), np.arange(shards + 1)) if shards else []
    for s, part in occupied(cuts):
        keys, counts = _files(model.path, "words", s, WORD_FILES)
        at = place(keys, hashes[part])
        known = at >= 0
        number[part][known] = at[known] + model.offsets[s]
        count[part][known] = counts[at[known]]
        if weights:
            l, b = _files(model.path, "words", s, WEIGHT_FILES)
            left[part][known], backoff[part][known] = l[at[known]], b[at[known]]
    return [number, count, left, backoff]


def numbered(model: Model, texts: pa.Array, weights: bool):
    """Tokens of a slice of texts as indexes into its distinct tokens, with what is known of those."""
    hashes, ends = tokens(texts)
    distinct, index = np.unique(hashes, return_inverse=True)
    return index, ends, look_up(model, distinct, weights)


def discounts(n: np.ndarray) -> np.ndarray:
    """The three discounts from how many entries occur once to four times.

    Where these are too few to give discounts from 0 to the count, 0.5, 1 and 1.5.
    """
    if (n[:3] > 0).all():
        y = n[0] / (n[0] + 2 * n[1])
        d = np.array([k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)])
        if (d > 0).all() and (d <= [1, 2, 3]).all():
            return d
    return np.array([0.5, 1.0, 1.5])


def of_count(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The discount of each count."""
    return np.concatenate([[0.0], d])[np.minimum(counts, 3).astype(np.int64)]


def classes(counts: np.ndarray, most: int) -> np.ndarray:
    """How many counts are 1, 2, ... and ``most`` or more."""
    return np.bincount(np.minimum(counts, most).astype(np.int64), minlength=most + 1)[1:]


def _words(docs: DataFrame, model: Model, shards: int) -> None:
    """The first pass: vocabulary files, offsets and sums."""
    path = model.path

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Gathered(lambda keys: shard_of(keys, shards))
        for batch in batches:
            for part in slices(batch["text"], SLICE):
                yield from found.add(tokens(part)[0])
        yield from found.send()

    def merge(rows: pa.Table) -> pa.Table:
        s = rows["shard"][0].as_py()
        keys, counts = joined([opened(r) for r in rows.to_pylist()])
        put(path, f"words-{s}.keys", keys)
        put(path, f"words-{s}.counts", counts)
        return pa.table({"shard": pa.array([s], pa.int32()), "size": [len(keys)], "total": [int(counts.sum())],
                         "texts": [int(counts[keys == END].sum())]})

    sums = docs.select("text").mapInArrow(count, BLOCK_DDL).groupBy("shard").applyInArrow(
        merge, "shard int, size long, total long, texts long")
    rows = {r["shard"]: r for r in materialize(sums, "vocabulary").collect()}  # a row per shard
    for s in set(range(shards)) - set(rows):
        put(path, f"words-{s}.keys", EMPTY)
        put(path, f"words-{s}.counts", np.zeros(0, np.int64))
    model.offsets = np.cumsum([0, *[rows[s]["size"] if s in rows else 0 for s in range(shards)]])
    if model.words >= 1 << 32:
        raise OverflowError(f"{model.words} distinct words do not fit the pairs of 32-bit word numbers")
    model.total, model.texts = (sum(r[name] for r in rows.values()) for name in ("total", "texts"))


def _pairs(docs: DataFrame, model: Model) -> None:
    """The second pass: bigram files per shard, then the weights of each word."""
    path, start, cuts = model.path, model.words, model.offsets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(keys: np.ndarray) -> np.ndarray:
            return model.shard(keys, counts_of(model, (keys >> np.uint64(32)).astype(np.int64)))

        found = Gathered(shard)
        for batch in batches:
            for part in slices(batch["text"], SLICE):
                index, ends, (number, *_) = numbered(model, part, False)
                right = number[index]
                yield from found.add(before(right, ends, start) << np.uint64(32) | right)
        yield from found.send()

    def merge(rows: pa.Table) -> pa.Table:
        s = rows["shard"][0].as_py()
        keys, counts = joined([opened(r) for r in rows.to_pylist()])
        hashes = pair_hash(keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF))
        order = np.argsort(hashes)
        put(path, f"pairs-{s}.keys", hashes[order])
        put(path, f"pairs-{s}.counts", narrowed(counts[order]))
        first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        words, at = np.unique(first, return_inverse=True)
        kinds = np.bincount(at * 3 + np.minimum(counts, 3) - 1, minlength=3 * len(words))
        out = [parts_of(s, k, words, kinds[k::3]) for k in range(3)]
        words, n = np.unique(second, return_counts=True)
        out.append(parts_of(s, 3, words, n))
        out.append([{"shard": -1, "kind": 0, "size": len(keys), "keys": b"", "counts": packed(classes(counts, 5))}])
        return pa.Table.from_pylist([r for part in out for r in part], schema=PARTS)

    def parts_of(s: int, kind: int, words: np.ndarray, n: np.ndarray) -> list[dict]:
        words, n = words[n > 0], n[n > 0]
        home = np.searchsorted(cuts, words, side="right") - 1  # the start mark lies behind the last word
        return [{"shard": h, "kind": kind, "size": int((home == h).sum()),
                 "keys": packed(np.diff(words[home == h], prepend=0).astype(np.uint32)),
                 "counts": packed(n[home == h].astype(np.uint32))} for h in np.unique(home).tolist()]

    parts = docs.select("text").mapInArrow(count, BLOCK_DDL).groupBy("shard").applyInArrow(merge, PARTS_DDL)
    parts = materialize(parts, "bigram-sums")
    kinds = np.zeros(5, np.int64)
    for r in parts.filter("shard = -1").toLocalIterator():  # a row per shard
        kinds += unpacked(r["counts"], np.int64, 5)
        model.pairs += r["size"]
    model.discounts = discounts(kinds)
    d = model.discounts

    def weigh(rows: pa.Table) -> pa.Table:
        s = rows["shard"][0].as_py()
        size = int(cuts[s + 1] - cuts[s]) if s + 1 < len(cuts) else 1
        base = int(cuts[s]) if s < len(cuts) else start
        n = np.zeros((4, size), np.int64)
        for r in rows.to_pylist():
            at = np.cumsum(unpacked(r["keys"], np.uint32, r["size"]), dtype=np.int64) - base
            n[r["kind"], at] += unpacked(r["counts"], np.uint32, r["size"])
        mark = s + 1 >= len(cuts)
        total = np.array([model.texts]) if mark else mapped(path, f"words-{s}.counts", np.int64)
        backoff = (d[:, None] * n[:3]).sum(0) / np.maximum(total, 1)
        name = "start" if mark else f"words-{s}"
        put(path, f"{name}.left", n[3].astype(np.uint32))
        # A word that no bigram begins with (the end mark) leaves all to the lower order.
        put(path, f"{name}.backoff", np.where(n[:3].any(0), backoff, 1.0).astype(np.float32))
        return pa.table({"left": [packed(classes(n[3], 5))]})

    done = parts.filter("shard >= 0").groupBy("shard").applyInArrow(weigh, "left binary")
    left = sum([unpacked(r["left"], np.int64, 5) for r in materialize(done, "word-weights").collect()], np.zeros(5, np.int64))
    model.lower = discounts(left)
    model.left = np.array([left[0], left[1], left[2:].sum()])
    for s in range(len(cuts) - 1):
        for name, values in (("left", np.zeros(0, np.uint32)), ("backoff", np.zeros(0, np.float32))):
            if cuts[s] == cuts[s + 1]:
                put(path, f"words-{s}.{name}", values)


PARTS = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("size", pa.int64()), ("keys", pa.binary()),
                   ("counts", pa.binary())])
PARTS_DDL = "shard int, kind int, size long, keys binary, counts binary"


def counts_of(model: Model, numbers: np.ndarray) -> np.ndarray:
    """How often words occur in the learning texts, by sorted numbers; the start mark once a text."""
    out = np.full(len(numbers), model.texts, np.int64)
    cuts = np.searchsorted(numbers, model.offsets)
    for s, part in occupied(cuts):
        _, counts = _files(model.path, "words", s, WORD_FILES)
        out[part] = counts[numbers[part] - model.offsets[s]]
    return out


def fit(docs: DataFrame) -> Model:
    """Count the texts of ``docs`` (text) and write the model."""
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    model = Model(folder(docs.sparkSession), np.zeros(1, np.int64), size // PAIR_BYTES + 1)
    _words(docs, model, size // WORD_BYTES + 1)
    if model.words:
        _pairs(docs, model)
    return model


def pair_counts(model: Model, pairs: np.ndarray, often: np.ndarray) -> np.ndarray:
    """How often each pair of word numbers occurs; often: how often its first word does."""
    shard, hashes = model.shard(pairs, often), pair_hash(pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF))
    out, order = np.zeros(len(pairs), np.int64), np.lexsort((hashes, shard))
    cuts = np.searchsorted(shard[order], np.arange(model.shards + 1))
    for s, rows in occupied(cuts):
        part = order[rows]
        if os.path.exists(os.path.join(model.path, f"pairs-{s}.keys")):
            keys, counts = _files(model.path, "pairs", s, PAIR_FILES)
            at = place(keys, hashes[part])
            out[part[at >= 0]] = counts[at[at >= 0]]
    return out


def probabilities(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's probability and count, and where each text ends."""
    index, ends, (number, count, left, backoff) = numbered(model, texts, model.words > 0)
    if not model.words:
        return np.ones(len(index)), np.zeros(len(index)), ends
    lower = np.maximum(left - of_count(model.lower, left), 0) / model.pairs
    lower += (model.lower * model.left).sum() / model.pairs / (model.words + 1)
    # the start mark and what is known of it, behind the slice's own tokens
    mark = len(number)
    number = np.append(number, np.uint64(model.words))
    count = np.append(count, model.texts)
    backoff = np.append(backoff, mapped(model.path, "start.backoff", np.float32)[0])
    pair, back = np.unique(before(index, ends, mark) * (mark + 1) + index, return_inverse=True)
    first, second = np.divmod(pair, mark + 1)
    c = np.zeros(len(pair), np.int64)
    known = (count[first] > 0) & (count[second] > 0)
    c[known] = pair_counts(model, number[first[known]] << np.uint64(32) | number[second[known]], count[first[known]])
    p = np.maximum(c - of_count(model.discounts, c), 0) / np.maximum(count[first], 1) + backoff[first] * lower[second]
    return p[back], count[index], ends


def score(model: Model, text: str | Column) -> Column:
    """A struct column (n_tokens, n_known, base_score, score) for a text column."""
    kind = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()),
                      ("score", pa.float64())])

    @F.arrow_udf("struct<n_tokens: bigint, n_known: bigint, base_score: double, score: double>")
    def scores(column: pa.Array) -> pa.Array:
        found = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2]
        for part in slices(column, SLICE):
            p, count, ends = probabilities(model, part)
            starts = np.concatenate([[0], ends[:-1]])
            base = np.log10((count + 0.5) / (model.total + 0.5 * (model.words + 1)))
            found.append([ends - starts, *[np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64), base, np.log10(p))]])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], fields=list(kind))
    return scores(text)
