"""Learned models: held-out accuracy, a brute-force language model, and odd input."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketlake.llm import kneser_ney, langid, quality
from docketlake.llm.text import fold, sampled

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "123 ... $$$"), (4, "the word " * 20000), (None, "a b"), (4, "x")]


def odd(spark):
    return spark.createDataFrame([(*r, "taken") for r in ODD], "doc_id long, text string, score string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_fold_is_crc32(spark):
    rows = spark.range(50).withColumn("f", fold("id", 3)).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in rows)


def test_sample_is_bounded_and_repeatable(spark):
    rows = spark.range(20000).select((F.col("id") % 2).alias("g"), "id")
    first, second = (sampled(rows, "g", 100, "x").collect() for _ in range(2))
    assert sorted(first) == sorted(second) and 120 < len(first) < 280
    repeated = spark.range(5000).select(F.lit(1).alias("g"), F.lit(1).alias("id"))
    assert sampled(repeated, "g", 10, "x", 2).count() <= 20


# --- languages -----------------------------------------------------------------


@pytest.fixture(scope="module")
def languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.fit(docs.filter(fold("doc_id", 3) != 1))


def test_languages_held_out(spark, languages):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(fold("doc_id", 3) == 1)
    rows = docs.select("lang", langid.predict(languages, "text", spark).alias("p")).select("lang", "p.*").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert (languages.weights == 0).mean() > 0.9  # sparse


def test_no_language_is_left_out(spark):
    rng = np.random.default_rng(4)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(8)] for _ in range(70)]
    rows = spark.createDataFrame(
        [(" ".join(rng.choice(words[k], 12)), f"l{k:02}") for k in range(70) for _ in range(6 + k % 3)], "text string, lang string")
    model = langid.fit(rows)
    assert model.languages == [f"l{k:02}" for k in range(70)]
    found = rows.select("lang", langid.predict(model, "text", spark).alias("p")).select("lang", "p.lang_pred").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.9
    many = spark.range(30000).select((F.col("id") % 100).alias("g"), "id")
    drawn = sampled(many, "g", 100, "x", 10)
    assert drawn.select("g").distinct().count() == 100 and drawn.count() <= 2 * 50 * 100


def test_languages_odd(spark, languages):
    rows = odd(spark).select("doc_id", "score", langid.predict(languages, "text", spark).alias("p")).collect()
    assert [r["p"]["lang_pred"] == langid.UND for r in rows] == [True, True, True, False, False, False]
    assert [r["p"]["score"] for r in rows][:3] == [0, 0, 0]
    nothing = langid.fit(empty(spark))
    assert {r["p"]["lang_pred"] for r in odd(spark).select(langid.predict(nothing, "text", spark).alias("p")).collect()} == {"und"}
    assert empty(spark).select(langid.predict(languages, "text", spark)).count() == 0


def test_windows_have_the_ngrams_of_the_whole(monkeypatch):
    rng = np.random.default_rng(2)
    for _ in range(60):
        text = "".join(rng.choice(list("ab É1  "), rng.integers(8, 60)))
        whole = next(langid.ngrams(pa.array([text])))
        monkeypatch.setattr(langid, "WINDOW", int(rng.integers(1, 8)))
        parts = list(langid.ngrams(pa.array([text])))
        monkeypatch.setattr(langid, "WINDOW", 1 << 20)
        assert [p[3] for p in parts] == [True] * (len(parts) - 1) + [False]
        got = np.concatenate([p[0].ravel() for p in parts])
        want = whole[0].ravel()
        assert (np.sort(got[got != langid.NO_NGRAM]) == np.sort(want[want != langid.NO_NGRAM])).all()
        assert sum(p[2][0] for p in parts) == whole[2][0]


def test_a_very_long_text_takes_bounded_memory(spark, languages):
    """Thirty million characters: named as its parts are, in little more memory than the text's own."""
    import tracemalloc

    text = "das ist ein Satz der sich oft wiederholt und " * 700_000
    tracemalloc.start()
    for _ in langid.ngrams(pa.array([text])):
        pass
    assert tracemalloc.get_traced_memory()[1] < 250e6
    tracemalloc.stop()
    docs = spark.createDataFrame([(text,), (text[:2000],)], "text string")
    a, b = (r["p"] for r in docs.select(langid.predict(languages, "text", spark).alias("p")).collect())
    assert a["lang_pred"] == b["lang_pred"] and abs(a["score"] - b["score"]) < 0.02


def test_ngrams_stay_within_their_text():
    apart = [b for t in ("ab", "", "cd e") for b in [next(langid.ngrams(pa.array([t])))[0]]]
    together = next(langid.ngrams(pa.array(["ab", "", "cd e"])))[0]
    assert (np.concatenate(apart) == together).all()


def test_document_frequencies(spark):
    rows = spark.createDataFrame([("ab",), ("ab ab",), ("...",), (None,)], "text string")
    frequency, n = langid.document_frequencies(rows.filter("text is not null"))
    assert n == 2 and frequency.max() == 2 and frequency.sum() == 2 * 8 + 1  # "b a" only in one


def test_temperature_undoes_scaling():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in langid.softmax(logits)])
    assert langid.temperature(logits * 4, labels) == pytest.approx(4, rel=0.15)


# --- quality -------------------------------------------------------------------


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rated = quality.grades(spark.read.parquet(f"{sf}/labels.parquet"))
    model = quality.fit(docs, rated.filter(fold("doc_id", 3) != 1))
    held = docs.join(rated.filter(fold("doc_id", 3) == 1), "doc_id")
    rows = held.select("grade", quality.predict(model, "text", spark).alias("p")).select("grade", "p.*").collect()
    kept = {g: np.mean([r["tails"][-1] >= quality.LEAST for r in rows if r["grade"] == g]) for g in range(3)}
    assert kept[2] > 0.98 and kept[0] < 0.25  # few hundred ratings of each rare grade to learn from
    assert np.mean([(r["tails"][-1] >= 0.5) == (r["grade"] == 2) for r in rows]) > 0.88
    assert all(r["tails"][0] >= r["tails"][1] for r in rows)  # ordered thresholds
    assert all(r["expected_grade"] == pytest.approx(sum(r["tails"])) for r in rows)


def test_quality_held_out_toxic_by_language(spark):
    """Texts that were not learned from, also not as copies."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rated = quality.grades(spark.read.parquet(f"{sf}/labels.parquet"))
    learned, held = rated.filter(fold("doc_id", 3) != 1), rated.filter(fold("doc_id", 3) == 1)
    model = quality.fit(docs, learned)
    new = docs.join(held, "doc_id").join(docs.join(learned, "doc_id").select("text"), "text", "left_anti")
    p = quality.predict(model, "text", spark)
    rows = new.select("lang", "grade", p.alias("p")).select("lang", "grade", quality.selected(F.col("p.tails")).alias("keep"))
    kept = defaultdict(list)
    for r in rows.collect():
        kept[r["grade"]].append(r["keep"])
        kept[r["grade"], r["lang"]].append(r["keep"])
    kept = {k: (sum(v), len(v)) for k, v in kept.items()}
    share = {k: n / of for k, (n, of) in kept.items()}
    assert share[2] > 0.98 and share[1] < 0.45, kept
    assert all(share[1, lang] < 0.75 for lang in ("de", "en", "es", "fr")), kept


def test_quality_odd(spark):
    none = quality.fit(empty(spark), spark.createDataFrame([], "doc_id long, grade int"))
    rows = odd(spark).select(quality.predict(none, "text", spark).alias("p")).collect()
    assert [r["p"]["tails"] for r in rows] == [[0.5]] * len(ODD)
    assert odd(spark).filter(quality.selected(F.array(F.lit(0.5)))).count() == len(ODD)
    ratings = quality.grades(spark.createDataFrame(
        [(4, 1, 0), (1, 0, None), (2, 1, None), (3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    assert sorted((r["doc_id"], r["grade"]) for r in ratings.collect()) == [(1, 0), (2, 2), (4, 2)]
    model = quality.fit(odd(spark), ratings)
    assert odd(spark).select(quality.predict(model, "text", spark)).count() == len(ODD)


def test_gradient_of_the_ordinal_loss():
    rng = np.random.default_rng(3)
    n = 600
    ids, ends = np.arange(n) % 5, np.arange(1, n + 1)
    grade = np.minimum(ids // 2, 2) + (rng.random(n) < 0.1)
    model = quality.learn(ids, np.ones(n), ends, np.minimum(grade, 2), np.bincount(np.minimum(grade, 2)) / n)
    tails = model.tails(model.weights[:5])
    for k in (1, 2):
        seen = [(np.minimum(grade, 2)[ids == i] >= k).mean() for i in range(5)]
        assert np.corrcoef(tails[:, k - 1], seen)[0, 1] > 0.9


# --- language model --------------------------------------------------------------


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + ["</s> "]


class Brute:
    """The same model over dictionaries."""

    def __init__(self, texts):
        rows = [split(t) for t in texts]
        self.c = Counter(w for r in rows for w in r)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.pairs = Counter(p for r in rows for p in zip(["<s> ", *r], r))
        self.left = Counter(b for _, b in self.pairs)
        self.context, self.mass = Counter(), defaultdict(float)
        self.d, self.e = self.discounts(self.pairs), self.discounts(self.left)
        for (a, _), n in self.pairs.items():
            self.context[a] += n
            self.mass[a] += self.d[min(n, 3)]

    @staticmethod
    def discounts(counts):
        n = [sum(x == k for x in counts.values()) for k in range(5)]
        if all(n[1:4]):
            y = n[1] / (n[1] + 2 * n[2])
            d = [0, *[k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]]
            if all(0 < d[k] <= k for k in (1, 2, 3)):
                return d
        return [0, 0.5, 1.0, 1.5]

    def lower(self, w):
        k, b = self.left[w], len(self.pairs)
        return max(k - self.e[min(k, 3)], 0) / b + sum(self.e[min(x, 3)] for x in self.left.values()) / b / (self.v + 1)

    def p(self, a, w):
        if a not in self.context:
            return self.lower(w)
        n = self.pairs[a, w]
        return (max(n - self.d[min(n, 3)], 0) + self.mass[a] * self.lower(w)) / self.context[a]


def test_kneser_ney_against_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "PAIR_BYTES", 1 << 14)  # many shards
    monkeypatch.setattr(kneser_ney, "WORD_BYTES", 1 << 15)
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 150").select("doc_id", "text").union(
        odd(spark).select("doc_id", "text"))
    train = docs.filter(fold("doc_id", 5) != 1)
    model = kneser_ney.fit(train)
    assert model.shards > 5 and len(model.offsets) > 4
    brute = Brute([r["text"] for r in train.collect()])
    assert (model.total, model.words) == (brute.n, brute.v)
    vocabulary = [*brute.c, "never seen"]
    for a in ("<s> ", "the", "never seen"):
        assert sum(brute.p(a, w) for w in vocabulary) == pytest.approx(1)
    for r in docs.select("text", kneser_ney.score(model, "text").alias("p")).collect():
        words, p = split(r["text"]), r["p"]
        assert p["n_tokens"] == len(words) and p["n_known"] == sum(w in brute.c for w in words)
        assert p["base_score"] == pytest.approx(sum(
            math.log10((brute.c[w] + 0.5) / (brute.n + 0.5 * (brute.v + 1))) for w in words))
        assert p["score"] == pytest.approx(sum(math.log10(brute.p(*ab)) for ab in zip(["<s> ", *words], words)), rel=1e-5)


def test_kneser_ney_without_texts(spark):
    model = kneser_ney.fit(empty(spark))
    rows = odd(spark).select(kneser_ney.score(model, "text").alias("p")).collect()
    assert [r["p"]["score"] for r in rows] == [0.0] * len(ODD)
    assert [r["p"]["n_tokens"] for r in rows] == [1, 1, 4, 40001, 3, 2]
    assert empty(spark).select(kneser_ney.score(model, "text")).count() == 0


def test_kneser_ney_needs_a_mounted_folder(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *a: "hdfs://x/y")

    with pytest.raises(ValueError):
        kneser_ney.folder(Elsewhere)


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    counts = rng.integers(1, 9, len(keys))
    got = kneser_ney.opened(kneser_ney.block(3, keys, counts))
    assert (got[0] == keys).all() and (got[1] == counts).all()


# --- counts beyond four bytes ------------------------------------------------------


def test_counts_above_four_bytes(tmp_path):
    keys = np.array([3, 1 << 40, 1 << 63], np.uint64)
    for counts in ([1, 2, 3], [1, 2**32 - 1, 5], [1, 2**32, 7 * 10**12]):
        counts = np.array(counts, np.int64)
        got = kneser_ney.opened(kneser_ney.block(0, keys, counts))
        assert (got[0] == keys).all() and (got[1] == counts).all()
        path = str(tmp_path / str(counts.max()))
        kneser_ney.put(path, "pairs-0.keys", keys)
        kneser_ney.put(path, "pairs-0.counts", kneser_ney.narrowed(counts))
        stored = kneser_ney._files(path, "pairs", 0, kneser_ney.PAIR_FILES)
        assert (stored[1] == counts).all() and stored[1].itemsize == (8 if counts.max() >= 2**32 else 4)


def test_only_occupied_shards_are_visited():
    cuts = np.searchsorted(np.array([5, 5, 70_000, 999_999]), np.arange(1_000_001))
    assert [(s, p.stop - p.start) for s, p in kneser_ney.occupied(cuts)] == [(5, 2), (70_000, 1), (999_999, 1)]
