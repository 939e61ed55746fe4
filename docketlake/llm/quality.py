"""Quality by ordinal cumulative-link regression on graded ratings.

A rating is a grade from 0 up. One set of weights over hashed text features is
shared by all grades; ordered thresholds cut the score, with a logistic link:
P(grade >= k) = sigmoid(score - threshold k). Features are a text's words (lower
case, letters and digits only), their first four letters, and the shapes of its
tokens (runs of letters, capitals and digits as one sign); a feature's value is one
plus the logarithm of its count. The weights are learned on the driver from a
bounded sample of rated texts (``PER_GRADE`` rows of each grade, by hash), weighted
back to the grades' true shares. Features whose likelihood-ratio statistic against
the grade stays under the low ``LEAST_TEST`` have no weight: texts hold far more
words than there are ratings. The penalty does the rest, so that the rarer signs of
rare grades count too. Every text is scored whole.

Null and empty texts have no features and get the score zero. Rows without rating
teach nothing. Without any rating every text gets grade 0 with probability one half.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.text import Words, sampled, slices
from docketlake.session import materialize

BITS = 18
#: A text is selected if its best grade is at least so likely.
LEAST = 0.4
#: Bound of the sample that the weights are learned from, and most grades.
PER_GRADE, GRADES = 2000, 8
#: Statistic that a feature must reach, penalty, and rounds and memory of the descent.
LEAST_TEST, L2, ROUNDS, MEMORY = 5.0, 1e-4, 150, 10


def _buckets(values: pa.Array, kind: int) -> np.ndarray:
    """A bucket for each string, -1 for an empty one."""
    coded = values.dictionary_encode()
    digest, mask = xxhash.xxh64_intdigest, (1 << BITS) - 1
    each = [digest(v, kind) & mask if v else -1 for v in coded.dictionary.to_pylist()]
    return np.array([*each, -1], np.int64)[coded.indices.to_numpy()]


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: each text's distinct buckets one after another, their values, each text's end."""
    for part in slices(texts):
        words = Words(part)
        plain = pc.replace_substring_regex(pc.utf8_lower(words.distinct), r"[^\p{L}\p{N}]+", "")
        shape = pc.replace_substring_regex(words.distinct, r"\p{Lu}{2,}", "AA")
        for pattern, sign in ((r"[\p{Ll}\p{Lo}\p{Lm}]+", "a"), (r"\p{N}+", "0")):
            shape = pc.replace_substring_regex(shape, pattern, sign)
        start = pc.utf8_slice_codeunits(plain, 0, 4)
        owner = np.repeat(np.arange(len(part)), words.ends - words.starts)
        pairs = []
        for bucket in (_buckets(plain, 1), _buckets(shape, 2), _buckets(start, 3)):
            b = bucket[words.ids] if len(words.ids) else np.zeros(0, np.int64)
            pairs.append((owner << BITS | b)[b >= 0])
        pair, n = np.unique(np.concatenate(pairs), return_counts=True)
        yield pair & ((1 << BITS) - 1), 1 + np.log(n), np.cumsum(np.bincount(pair >> BITS, minlength=len(part)))


def sparse(text: str | Column) -> Column:
    """A text's buckets and values, for the bounded sample."""
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))])

    @F.arrow_udf("struct<ids: array<int>, x: array<float>>")
    def rows(texts: pa.Array) -> pa.Array:
        out = []
        for bucket, value, ends in features(texts):
            out += [{"ids": i.astype(np.int32), "x": v.astype(np.float32)}
                    for i, v in zip(np.split(bucket, ends[:-1]), np.split(value, ends[:-1]))]
        return pa.array(out, kind)
    return rows(text)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one per grade above 0

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a column each."""
        return sigmoid(score[:, None] - self.thresholds)


def telling(ids: np.ndarray, owner: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """The buckets whose presence depends on the grade, by the likelihood-ratio statistic."""
    top, size = int(grade.max()) + 1, 1 << BITS
    rows = np.bincount(grade, minlength=top).astype(float)
    seen = np.stack([np.bincount(ids[grade[owner] == k], minlength=size) for k in range(top)]).astype(float)
    share, total = rows / rows.sum(), seen.sum(0)
    test = np.zeros(size)
    for k in range(top):
        for observed, expected in ((seen[k], total * share[k]), (rows[k] - seen[k], (rows.sum() - total) * share[k])):
            some = observed > 0
            test[some] += 2 * observed[some] * np.log(observed[some] / expected[some])
    return np.flatnonzero(test >= LEAST_TEST)


def descend(loss: Callable, x: np.ndarray) -> np.ndarray:
    """Limited-memory quasi-Newton descent of a function that returns value and gradient."""
    value, gradient = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        way, scales = gradient.copy(), []
        for s, y in reversed(steps):
            scales.append((s @ way) / (s @ y))
            way -= scales[-1] * y
        way *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1, np.linalg.norm(way))
        for (s, y), a in zip(steps, reversed(scales)):
            way += s * (a - (y @ way) / (s @ y))
        step = 1.0
        while True:
            there, slope = loss(x - step * way), step * (gradient @ way)
            if there[0] <= value - 1e-4 * slope or step < 1e-8:
                break
            step /= 2
        s, y = -step * way, there[1] - gradient
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-MEMORY:]
        done = abs(value - there[0]) < 1e-8 * max(1, abs(value))
        x, (value, gradient) = x + s, there
        if done:
            break
    return x


def learn(ids: np.ndarray, x: np.ndarray, ends: np.ndarray, grade: np.ndarray, share: np.ndarray) -> Model:
    """Fit the cumulative-link log loss; ``share`` is each grade's share of all rated rows."""
    top, owner = int(grade.max()), np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    used = telling(ids, owner, grade)
    column = np.full(1 << BITS, -1)
    column[used] = np.arange(len(used))
    known = column[ids] >= 0
    col, x, owner, size, at = column[ids[known]], x[known].astype(float), owner[known], len(used), np.arange(len(ends))
    weight = (share / np.maximum(np.bincount(grade, minlength=len(share)), 1))[grade]
    weight /= weight.sum()

    def cuts_of(base: float, gaps: np.ndarray) -> np.ndarray:
        return base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, cuts = p[:size], cuts_of(p[size], p[size + 1 :])
        score = np.bincount(owner, x * w[col], len(ends))
        tails = np.column_stack([np.ones(len(score)), sigmoid(score[:, None] - cuts), np.zeros(len(score))])
        slope, chance = tails * (1 - tails), np.maximum(tails[at, grade] - tails[at, grade + 1], 1e-12)
        up, down = weight * slope[at, grade] / chance, weight * slope[at, grade + 1] / chance
        by_cut = np.array([up[grade == k].sum() - down[grade == k - 1].sum() for k in range(1, top + 1)])
        after = np.cumsum(by_cut[::-1])[::-1]  # a gap moves its cut and all above
        return (L2 / 2 * (w @ w) - (weight * np.log(chance)).sum(),
                np.concatenate([np.bincount(col, x * (down - up)[owner], size) + L2 * w, after[:1],
                                after[1:] * np.exp(p[size + 1 :])]))

    tail = np.clip([weight[grade >= k].sum() for k in range(1, top + 1)], 1e-3, 1 - 1e-3)
    first = np.log((1 - tail) / tail)  # thresholds of a constant model
    p = descend(loss, np.concatenate([np.zeros(size), first[:1], np.log(np.maximum(np.diff(first), 1e-2))]))
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = p[:size]
    return Model(weights, cuts_of(p[size], p[size + 1 :]))


def grades(labels: DataFrame) -> DataFrame:
    """Rated rows (doc_id, grade): 0 bad, 1 good but toxic, 2 good."""
    good = F.when(F.col("quality") >= 1, F.when(F.coalesce("toxic", F.lit(0)) >= 1, 1).otherwise(2)).otherwise(0)
    return labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", good.alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, per_grade: int = PER_GRADE) -> Model:
    """Learn from the texts of ``docs`` that ``ratings`` (doc_id, grade) rates."""
    rated = materialize(ratings.join(docs.select("doc_id"), "doc_id", "left_semi"), "rated")
    rated = rated.filter(F.col("grade").between(0, GRADES - 1))
    counts = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}
    sample = sampled(rated, "grade", per_grade, "quality", GRADES).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    rows = rows.limit(2 * per_grade * GRADES)  # identifiers may repeat
    table = rows.select("grade", sparse("text").alias("x")).toArrow()
    grade = table["grade"].to_numpy().astype(np.int64)
    if not len(grade) or grade.max() < 1:
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(1))
    ids, x = (pc.struct_field(table["x"].combine_chunks(), name) for name in ("ids", "x"))
    ends = np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64))
    share = np.array([counts.get(k, 0) for k in range(int(grade.max()) + 1)], float)
    return learn(ids.flatten().to_numpy(), x.flatten().to_numpy(), ends, grade, share)


def predict(model: Model, text: str | Column, spark) -> Column:
    """A struct column (expected_grade, tails) for a text column; tails[k - 1] is P(grade >= k)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<expected_grade: double, tails: array<double>>")
    def rate(texts: pa.Array) -> pa.Array:
        m, found = shared.value, [np.zeros((0, len(shared.value.thresholds)))]
        for bucket, value, ends in features(texts):
            before = np.concatenate([[0.0], np.cumsum(value * m.weights[bucket])])
            found.append(m.tails(np.diff(before[ends], prepend=0)))
        tails = np.concatenate(found)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(tails) + 1, dtype=np.int32) * tails.shape[1]),
                                         pa.array(tails.ravel()))
        return pa.StructArray.from_arrays([pa.array(tails.sum(1)), lists], ["expected_grade", "tails"])
    # Not deterministic for the planner, which would else evaluate it once for each use.
    return rate.asNondeterministic()(text)


def selected(tails: Column, least: float = LEAST) -> Column:
    """Whether the best grade is at least as likely as ``least``; unrated models select all."""
    return F.element_at(tails, -1) >= least
