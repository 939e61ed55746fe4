"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to ``SYMBOLS`` symbols. Two words one edit apart have reduced words
at most one edit apart, so the neighbourhood of every reduced word (itself, each
deletion, each replacement) is generated and joined with the reduced vocabulary, and
what meets is verified on the original words. A pair needs to meet only once: the
longer word deletes, and of two words of one length the one with the smaller symbol
replaces, so insertions and the other half of the replacements are left out.

* A reduced word that more than ``HOT`` words share is joined as one row that only
  marks it. The words that reach it are then compared over the whole alphabet, where a
  neighbourhood names single words; so no bucket is ever squared, and no pair is lost.
* Neighbourhoods are merged with what they meet, never broadcast: Spark sizes the rows that a
  task makes of a word (40 and more, 900 over the whole alphabet) like the one it was made of.
* Words above ``LONG`` code points travel as 64-bit identifiers and are read again
  for their candidates, since each has as many neighbours as letters.

A word's form is its most frequent near word (the smallest of equals), if that is
``TIMES`` times as frequent; its root is where forms lead in the end. Frequencies
grow tenfold at each step, so pointer doubling ends after a few rounds.

Null and empty texts have no words. Null identifiers count as empty ones in the
choice of the letter that ``occurrences`` drops. Repeated rows count each. An empty
table gives an empty result. A text of any length is walked word by word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.text import slices
from docketlake.session import materialize

#: Words: least length in code points, least occurrences; how much more frequent a form is.
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: Symbols of the reduced alphabet; words that share a reduced word before it counts as hot.
SYMBOLS, HOT = 6, 64
#: Code points up to which words travel as strings.
LONG = 40
#: Different words that a task counts before it hands them on, and positions it edits at a time.
COUNTED, POSITIONS = 200_000, 1 << 16
#: An odd base for the codes of words, and its inverse, modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

LETTERS = "A-Za-zÀ-ÿ"


# --- vocabulary ------------------------------------------------------------------


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 0) -> DataFrame:
    """Words (word, n) of ``LEAST_LENGTH`` code points or more that occur ``LEAST_COUNT`` times.

    Words are maximal runs of letters, A-Z in lower case. With ``every`` > 0, one run in
    so many loses a letter: h is the crc32 of key, colon and run, and if ``every`` divides
    it the code point h modulo the length goes.
    """
    run = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        for batch in batches:
            at = 0
            keys = ["" if k is None else str(k) for k in batch["key"].to_pylist()]
            for part in slices(batch["text"]):
                for t in pc.ascii_lower(part).to_pylist():
                    salt = f"{keys[at]}:".encode()
                    at += 1
                    for found in run.finditer(t):
                        word = found.group()
                        if every:
                            h = zlib.crc32(salt + word.encode())
                            if h % every == 0:
                                k = h % len(word)
                                word = word[:k] + word[k + 1 :]
                                if len(word) < LEAST_LENGTH:
                                    continue
                        words[word] += 1
                    if len(words) > COUNTED:
                        yield _counted(words)
                        words.clear()
        yield _counted(words)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return (rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= LEAST_COUNT))


def _counted(words: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])


# --- codes -----------------------------------------------------------------------


def symbols(codes: np.ndarray, whole: bool) -> np.ndarray:
    """Code points as symbols from 1: hashed to ``SYMBOLS``, or each letter its own."""
    return (codes if whole else codes % SYMBOLS + 1).astype(np.uint64)


def _alphabet(whole: bool) -> list[int]:
    return [*range(0x61, 0x7B), *range(0xC0, 0x100)] if whole else list(range(1, SYMBOLS + 1))


class Edits:
    """The codes of a run of words, and of their neighbours.

    A word's code is the sum of its symbols times the powers of ``BASE``; an edit changes
    it by what lies before, at and behind the place. Codes may collide, which costs a
    candidate and loses nothing.
    """

    def __init__(self, words: list[str], whole: bool):
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        size = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size)
        self.word = np.repeat(np.arange(len(words)), size)
        self.last = np.zeros(len(flat), bool)
        self.last[ends[size > 0] - 1] = True
        self.symbol = symbols(flat, whole)
        place = np.arange(len(flat)) - np.repeat(ends - size, size)
        powers = np.full(int(size.max(initial=0)) + 1, BASE, np.uint64)
        powers[0] = 1
        self.power = np.multiply.accumulate(powers)[place]
        running = np.concatenate([[np.uint64(0)], np.cumsum(self.symbol * self.power, dtype=np.uint64)])
        start = running[ends - size]
        self.own = running[ends] - start
        self.before, self.to = running[:-1] - start[self.word], running[1:] - start[self.word]
        self.whole = whole

    def neighbours(self, both: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, code) of each word itself, its deletions, and its replacements by larger
        symbols, or by any other with ``both``; in steps of bounded size."""
        yield np.arange(len(self.own)), self.own
        for lo in range(0, len(self.word), POSITIONS):
            at = slice(lo, lo + POSITIONS)
            word, symbol, power = self.word[at], self.symbol[at], self.power[at]
            following = np.append(self.symbol[lo + 1 : lo + POSITIONS + 1], [np.uint64(0)])[: len(word)]
            keep = self.last[at] | (symbol != following)  # one deletion for a run of equal symbols
            behind = (self.own[word] - self.to[at]) * np.uint64(INVERSE)
            yield word[keep], (self.before[at] + behind)[keep]
            for other in _alphabet(self.whole):
                pick = symbol != other if both else symbol < other
                changed = self.own[word] + (np.uint64(other) - symbol) * power
                yield word[pick], changed[pick]


def _runs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of words of about ``POSITIONS`` letters; a longer word is a run of its own."""
    start = held = 0
    for k, w in enumerate(words):
        if held and held + len(w) > POSITIONS:
            yield start, k
            start, held = k, 0
        held += len(w)
    if start < len(words):
        yield start, len(words)


def _coded(vocabulary: DataFrame, carried: list[str], whole: bool, neighbours: bool | None) -> DataFrame:
    """(code, *carried) of each word (``neighbours`` None) or of its neighbourhood too
    (whether replacements go both ways)."""
    types = {f.name: f.dataType.simpleString() for f in vocabulary.schema.fields}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch["word"].to_pylist()
            for start, stop in _runs(words):
                edits = Edits(words[start:stop], whole)
                steps = [(np.arange(stop - start), edits.own)] if neighbours is None else edits.neighbours(neighbours)
                for word, codes in steps:
                    if len(word):
                        rows = pa.array(word + start)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(codes.view(np.int64)), *(batch[c].take(rows) for c in carried)], ["code", *carried])
    return vocabulary.mapInArrow(code, ", ".join(["code long", *(f"{c} {types[c]}" for c in carried)]))


# --- near words --------------------------------------------------------------------


def _renamed(rows: DataFrame, mark: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(c if c == "code" else f"{c}_{mark}") for c in rows.columns])


def _joined(near: DataFrame, targets: DataFrame) -> DataFrame:
    """Neighbourhoods with the words at their codes; their size is not what Spark takes it for."""
    return near.hint("merge").join(targets, "code")


def _met(vocabulary: DataFrame, partners: DataFrame, carried: list[str], verified) -> list[DataFrame]:
    """Candidate pairs (a: of ``vocabulary``, b: of ``partners``) that ``verified`` accepts.

    One frame from the reduced alphabet, and one from the whole alphabet for reduced words
    that are hot, if there are any.
    """
    own = materialize(_coded(partners, ["word", *(c for c in carried if c != "word")], False, None), "reduced-words")
    hot = materialize(own.groupBy("code").count().filter(F.col("count") > HOT).select("code"), "hot-reduced-words")
    some = not hot.isEmpty()
    targets = _renamed(own.select("code", *carried), "b")
    if some:
        marks = hot.select("code", *[F.lit(None).cast(own.schema[c].dataType).alias(f"{c}_b") for c in carried])
        targets = targets.join(hot, "code", "left_anti").unionByName(marks)
    near = _renamed(_coded(vocabulary, carried, False, False), "a")
    key = carried[0]
    met = _joined(near, targets).filter(F.col(f"{key}_b").isNull() | verified)
    met = materialize(met.drop("code"), "near-words")
    found = [met.filter(F.col(f"{key}_b").isNotNull())]
    if some:
        reach = met.filter(F.col(f"{key}_b").isNull()).select(F.col(f"{key}_a").alias(key)).distinct()
        words = vocabulary.join(reach, key, "left_semi")
        near = _renamed(_coded(words, carried, True, True), "a")
        crowded = own.join(hot, "code", "left_semi").drop("code")
        targets = _renamed(_coded(crowded, carried, True, None), "b")
        found.append(_joined(near, targets).filter(verified).drop("code"))
    return found


def near_words(vocabulary: DataFrame) -> DataFrame:
    """Each pair of words of ``vocabulary`` (word, n) one edit apart, once: (a, n_a, b, n_b)."""
    sized = vocabulary.select("word", "n", F.char_length("word").alias("size"), F.xxhash64("word").alias("id"))
    short = sized.filter(F.col("size") <= LONG).select("word", "n")
    one = lambda a, b: F.levenshtein(a, b, 1) == 1
    found = _met(short, short, ["word", "n"], one("word_a", "word_b"))
    longest = sized.agg(F.max("size").alias("size")).head()["size"] or 0
    if longest > LONG:
        long = sized.filter(F.col("size") > LONG).select("word", "id")
        partners = sized.filter(F.col("size") >= LONG).select("word", "id")
        pairs = _met(long, partners, ["id"], F.col("id_a") != F.col("id_b"))
        ids = materialize(pairs[0].unionByName(pairs[1]) if len(pairs) > 1 else pairs[0], "long-pairs").distinct()
        text = sized.filter(F.col("size") >= LONG).select("id", "word", "n")
        for mark in "ab":
            ids = ids.join(_renamed(text, mark), f"id_{mark}")
        found.append(ids.filter(one("word_a", "word_b")).select("word_a", "n_a", "word_b", "n_b"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    ordered = F.col("word_a") < F.col("word_b")
    return every.select(
        F.least("word_a", "word_b").alias("a"), F.when(ordered, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
        F.greatest("word_a", "word_b").alias("b"), F.when(ordered, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"),
    ).dropDuplicates(["a", "b"])


def variants(vocabulary: DataFrame) -> DataFrame:
    """Every word of ``vocabulary`` (word, n) with form, root, n, n_near and form_n."""
    vocabulary = materialize(vocabulary.select("word", "n"), "vocabulary")
    pairs = near_words(vocabulary)
    side = lambda w, near, n: F.struct(F.col(w).alias("word"), F.col(near).alias("near"), F.col(n).alias("m"))
    both = pairs.select(F.inline(F.array(side("a", "b", "n_b"), side("b", "a", "n_a"))))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    joined = vocabulary.join(best, "word", "left")
    takes = -F.col("best.m") >= TIMES * F.col("n")
    rows = materialize(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.m")).alias("form_n")), "forms")
    leads = materialize(rows.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = leads.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(leads.join(ahead, "root", "left").select("word", "root", "next"), "roots")
        leads = step.select("word", F.coalesce("next", "root").alias("root"))
        if step.filter(F.col("next").isNotNull()).isEmpty():
            break
    rows = rows.join(leads, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
