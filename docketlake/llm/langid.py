"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams of one to three of the folded text: letters
in lower case, runs of anything else as one space. A text's value for an n-gram is
its share among the text's n-grams times the inverse document frequency, which is
counted over every learning row. The weights are learned on the driver by
follow-the-regularised-leader with elastic-net penalties from a bounded sample
(``PER_LANGUAGE`` rows of each language, by hash; above ``LANGUAGES`` languages all
share the rows of that many, and none is left out); every fifth row of the sample is
set apart to fit the temperature that calibrates the probabilities.

A text that is null or has no letter is ``und`` with score 0. Without any learning
rows every text is ``und``. Rows without language or without letters teach nothing.
Only the text is used to predict. A text of any length is read whole, in windows of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.text import sampled, slices

ORDERS = (1, 2, 3)
BITS = 18
NO_NGRAM = 1 << BITS
#: Characters that are folded at a time; a longer text is read in windows.
WINDOW = 1 << 20
#: Bounds of the sample that the weights are learned from.
PER_LANGUAGE, LANGUAGES = 1500, 64
#: Step size, its offset, both penalties, passes, and the scale of the values.
RATE, OFFSET, L1, L2, PASSES, SCALE = 0.5, 1.0, 0.02, 1e-4, 2, 50.0
UND = "und"
SPACE = 32


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """For each code point the lower-case letter it counts as, or a space."""
    return np.array([ord(c.lower()[0]) if c.isalpha() else SPACE for c in map(chr, range(0x110000))], np.uint32)


def ngrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Per slice: a row of buckets for each position of the folded texts (``NO_NGRAM`` where
    an n-gram would leave its text), each text's end in the rows, its letters, and whether
    the slice is a window of one text that goes on in the next one."""
    for part in slices(texts, WINDOW):
        rows = part.to_pylist()
        if len(rows) == 1 and len(rows[0]) > WINDOW:
            yield from _windows(rows[0])
        else:
            code, text = _folded([f" {t} " for t in rows])
            letters = np.bincount(text[code != SPACE], minlength=len(rows))
            yield _buckets(code, text), np.cumsum(np.bincount(text, minlength=len(rows))), letters, False


def _folded(rows: list[str], before: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The codes of texts, runs of spaces as one, and each code's text; ``before`` stands before the first."""
    codes = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
    code = fold_table()[codes]
    text = np.repeat(np.arange(len(rows)), [len(t) for t in rows])
    space = code == SPACE
    keep = np.ones(len(code), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (text[1:] == text[:-1]))
    if before == SPACE and len(code):
        keep[0] = not space[0]
    return code[keep], text[keep]


def _buckets(code: np.ndarray, text: np.ndarray) -> np.ndarray:
    buckets, mixed = np.full((len(code), len(ORDERS)), NO_NGRAM, np.int32), np.zeros(len(code), np.uint32)
    for k, n in enumerate(ORDERS):
        size = max(len(code) - n + 1, 0)
        mixed = (mixed[:size] ^ code[n - 1 :]) * np.uint32(0x01000193)
        bucket = ((mixed + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        buckets[:size, k] = np.where(text[n - 1 :] == text[:size], bucket, NO_NGRAM)
    return buckets


def _windows(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """A long text in windows, which together have the n-grams of the whole: the last two codes
    of a window begin the next one, and wait there for those that follow."""
    wait = np.zeros(0, np.uint32)
    for start in range(0, len(text), WINDOW):
        last = start + WINDOW >= len(text)
        piece = (" " if start == 0 else "") + text[start : start + WINDOW] + (" " if last else "")
        code, _ = _folded([piece], int(wait[-1]) if len(wait) else 0)
        code = np.concatenate([wait, code])
        keep = 0 if last else min(2, len(code))
        buckets = _buckets(code, np.zeros(len(code), np.int64))[: len(code) - keep]
        letters = np.array([(code[: len(code) - keep] != SPACE).sum()])
        wait = code[len(code) - keep :]
        if len(buckets):
            yield buckets, np.array([len(buckets)]), letters, not last


class Counter:
    """Distinct buckets of one text after another, without sorting."""

    def __init__(self):
        self.last = np.zeros(NO_NGRAM + 1, np.int64)

    def distinct(self, buckets: np.ndarray) -> np.ndarray:
        buckets = buckets.ravel()
        place = np.arange(len(buckets))
        self.last[buckets] = place
        return buckets[self.last[buckets] == place]


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many rows of ``texts`` (text) hold each bucket, and how many rows there are."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, rows = Counter(), np.zeros(NO_NGRAM + 1, np.int64), 0
        held, some = np.zeros(NO_NGRAM + 1, bool), 0  # of a text in windows
        for batch in batches:
            for buckets, ends, letters, goes_on in ngrams(batch["text"]):
                if goes_on or held.any():
                    held[buckets.ravel()], some = True, some + int(letters[0])
                    if not goes_on:
                        total += held & (some > 0)
                        rows += some > 0
                        held[:], some = False, 0
                    continue
                rows += int((letters > 0).sum())
                for k, part in enumerate(np.split(buckets, ends[:-1])):
                    if letters[k]:
                        total[seen.distinct(part)] += 1
        some = np.flatnonzero(total[:NO_NGRAM])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(total[some], rows))], ["bucket", "n"])

    found = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = found.toArrow()  # at most one row per bucket
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    out = np.zeros(1 << BITS, np.int64)
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return out, int(n[bucket < 0].sum())


def counted(text: str | Column) -> Column:
    """A text's distinct buckets and their counts, for the bounded sample."""
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])

    @F.arrow_udf("struct<ids: array<int>, n: array<int>>")
    def counts(texts: pa.Array) -> pa.Array:
        rows, held, some = [], np.zeros(NO_NGRAM + 1, np.int64), 0  # of a text in windows
        for buckets, ends, letters, goes_on in ngrams(texts):
            if goes_on or held.any():
                held += np.bincount(buckets.ravel(), minlength=NO_NGRAM + 1)
                some += int(letters[0])
                if not goes_on:
                    ids = np.flatnonzero(held[:NO_NGRAM]) if some else np.zeros(0, np.int64)
                    rows.append({"ids": ids.astype(np.int32), "n": held[ids].astype(np.int32)})
                    held[:], some = 0, 0
                continue
            for k, part in enumerate(np.split(buckets, ends[:-1])):
                ids, n = np.unique(part[part != NO_NGRAM] if letters[k] else part[:0], return_counts=True)
                rows.append({"ids": ids.astype(np.int32), "n": n.astype(np.int32)})
        return pa.array(rows, kind)
    return counts(text)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Leader:
    """Follow-the-regularised-leader, per coordinate, for several classes."""

    def __init__(self, size: int, classes: int):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(self, at=None) -> np.ndarray:
        if at is None:  # in parts, as all buckets of many languages take much memory
            part = 1 << 14
            return np.concatenate([self.weights(np.s_[k : k + part]) for k in range(0, len(self.z), part)])
        z, n = self.z[at], self.n[at]
        step = (OFFSET + np.sqrt(n)) / RATE + L2
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / step)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax(values @ w)
        error[label] -= 1
        g = values[:, None] * error
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / RATE * w
        self.n[at] = more


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""
    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return -np.log(np.maximum(p, 1e-300)).mean()

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    """languages in order; weights: bucket x language, with idf, scale and temperature in them; the last row is zero."""

    languages: list[str]
    weights: np.ndarray
    temperature: float


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from ``rows`` (text, lang)."""
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    frequency, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    sample = sampled(rows, "lang", per_language, "langid", LANGUAGES)
    table = sample.select("lang", counted("text").alias("x")).select("lang", "x.*").toArrow().combine_chunks()
    names = table["lang"].to_pylist()
    ids, counts = (table[c].combine_chunks() for c in ("ids", "n"))
    ends = np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))
    ids, counts = ids.flatten().to_numpy(), counts.flatten().to_numpy()
    used = np.flatnonzero(np.diff(ends, prepend=0))  # texts with letters
    languages = sorted({names[k] for k in used})
    if not languages:
        return Model([], np.zeros((NO_NGRAM + 1, 0), np.float32), 1.0)

    def example(k: int) -> tuple[np.ndarray, np.ndarray, int]:
        part = slice(ends[k - 1] if k else 0, ends[k])
        n = counts[part]
        return ids[part], SCALE * n / n.sum() * idf[ids[part]], languages.index(names[k])

    leader, held, taught = Leader(1 << BITS, len(languages)), used[4::5], np.delete(used, np.s_[4::5])
    for _ in range(PASSES):
        for k in taught:
            leader.learn(*example(k))
    weights = leader.weights()
    judged = [(values @ weights[at], label) for at, values, label in map(example, held)]
    warm = temperature(*map(np.array, zip(*judged))) if judged else 1.0
    weights = np.append(weights * idf[:, None] * SCALE / warm, np.zeros((1, len(languages))), 0)
    return Model(languages, weights.astype(np.float32), warm)


def predict(model: Model, text: str | Column, spark) -> Column:
    """A struct column (lang_pred, score) for a text column."""
    shared = spark.sparkContext.broadcast(model)  # 2 ** BITS rows of a weight per language

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def classify(texts: pa.Array) -> pa.Array:
        names, weights = np.array([*shared.value.languages, UND], object), np.ascontiguousarray(shared.value.weights.T)
        labels, scores, k = [], [], len(names) - 1
        before = None  # sums of a text in windows
        for buckets, ends, letters, goes_on in ngrams(texts):
            starts = np.concatenate([[0], ends[:-1]])
            best, score = np.full(len(ends), k), np.zeros(len(ends))
            if k:
                total = np.stack([np.add.reduceat(w[buckets].sum(1), starts, dtype=np.float64) for w in weights], 1)
                n = np.add.reduceat((buckets != NO_NGRAM).sum(1), starts)
                if before:
                    total, n, letters = (x + y for x, y in zip((total, n, letters), before))
                before = (total, n, letters) if goes_on else None
            if goes_on:
                continue
            if k:
                p = softmax(total / n[:, None])
                some = letters > 0
                best[some], score[some] = p.argmax(1)[some], p.max(1)[some]
            labels.append(names[best])
            scores.append(score)
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate([np.zeros(0, object), *labels]), pa.string()),
             pa.array(np.concatenate([np.zeros(0), *scores]))], ["lang_pred", "score"])
    # Not deterministic for the planner, which would else evaluate it once for each use.
    return classify.asNondeterministic()(text)
