"""Spelling variants against brute force; the whole tables against SQL are in test_oracle."""

import random
import re
import zlib
from collections import Counter

import pytest

from docketlake.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = (form, n, len(near), words[form] if form else None)
    rows = {}
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (out[w][0], root, *out[w][1:])
    return rows


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def vocabulary(seed=3):
    rng, words = random.Random(seed), {}
    letters = "aeinortéßÀ"
    for size in [7, 8, 9, 39, 40, 41, 42, 90]:
        base = "".join(rng.choices(letters, k=size))
        words[base] = 5000
        for _ in range(25):
            w = list(base if rng.random() < 0.7 else rng.choice(list(words)))
            for _ in range(rng.choice([1, 1, 2])):
                k, step = rng.randrange(len(w)), rng.choice("idr")
                if step == "i":
                    w.insert(k, rng.choice(letters))
                elif step == "d" and len(w) > 7:
                    del w[k]
                else:
                    w[k] = rng.choice(letters)
            words["".join(w)] = rng.choice([2, 3, 30, 300])
    words.update({"aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaaa": 200, "gaaaaaa": 200, "mmmmmmm": 2})
    return words


@pytest.mark.parametrize("hot, long", [(64, 40), (1, 40), (64, 6), (1, 6)])
def test_near_words_and_forms(spark, monkeypatch, hot, long):
    """Every bucket hot, every word long, both, or neither: the result is the same."""
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "LONG", long)
    words = vocabulary()
    want = brute(words)
    assert sum(w[0] is not None for w in want.values()) > 20 and max(w[2] for w in want.values()) > 10
    assert found(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == want


def test_each_pair_meets_once():
    words = ["letters", "lettter", "setters", "letter", "lletters"]
    edits = spelling.Edits(words, False)
    reached = [set() for _ in words]
    for word, codes in edits.neighbours(False):
        for w, c in zip(word, codes):
            reached[w].add(int(c))
    own = [int(x) for x in edits.own]
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if i < j and one_edit(a, b):
                assert (own[j] in reached[i]) or (own[i] in reached[j])


def test_occurrences_of_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, "Spelling ÉCOLES spelling éCOLES x"), (3, "Spelling ÉCOLES spelling éCOLES x"),
             (None, "nowhere_nowhere nowhere"), (5, "wordwords " * 30000), (6, "a" * 100_000), (7, "a" * 100_000 + "1")]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, word int")
    want = Counter()
    for key, text in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            k = h % len(run)
            want[run[:k] + run[k + 1 :] if h % 2 == 0 else run] += 1
    want = {w: n for w, n in want.items() if n >= 2 and len(w) >= 7}
    got = spelling.occurrences(docs, every=2)
    assert {r["word"]: r["n"] for r in got.collect()} == want
    rows = found(spelling.variants(got))
    assert rows == brute(want)


@pytest.mark.parametrize("hot", [64, 1])
def test_neighbourhoods_are_not_broadcast(spark, monkeypatch, hot):
    """A small file of words has large neighbourhoods, over either alphabet: the left side of joins by code."""
    def joins(df):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        return re.findall(r"(\w+Join) \[code[^\n]*Inner([^\n]*)", plan)

    monkeypatch.setattr(spelling, "HOT", hot)
    words = spelling.materialize(
        spark.createDataFrame(list(vocabulary().items()), "word string, n long"), "vocabulary")
    met, real = [], spelling.materialize
    monkeypatch.setattr(spelling, "materialize", lambda df, name: met.extend(joins(df)) or real(df, name))
    met.extend(joins(spelling.near_words(words)))
    assert len(met) >= (2 if hot == 1 else 1)
    assert not any(kind == "BroadcastHashJoin" and "BuildLeft" in rest for kind, rest in met)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.occurrences(none)).count() == 0
