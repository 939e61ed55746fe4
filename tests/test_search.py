"""Prefix tiers against a level-by-level restatement, heads, lookups."""

import json
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from docketlake.operators import lookup, search
from docketlake.plans import documents


def clean(s):
    return re.sub("[^a-z0-9 ]", "", re.sub(r"\s+", " ", s.lower()).strip(" "))


def by_level(rows, cap, max_depth):
    """(prefix -> entry ids): each level keeps who sits in a crowded bucket."""
    out = {}
    for i, nm in rows:
        again = clean(nm)
        for d in (2, 3):
            if len(again) >= d:
                out.setdefault(again[:d], []).append(i)
    names = dict(rows)
    level = {i: clean(nm)[:3] for i, nm in rows if len(clean(nm)) >= 3}
    for depth in range(3, max_depth):
        size = Counter(level.values())
        level = {i: names[i][: depth + 1] for i, b in level.items()
                 if size[b] > cap and len(names[i]) > depth}
        for i, b in level.items():
            out.setdefault(b, []).append(i)
    return out


def head(ids, prefix, names, weight, cap):
    """Exactly named members first, then the heaviest; shown by weight."""
    order = lambda i: (-weight[i], names[i], i)
    return sorted(sorted(ids, key=lambda i: (names[i] != prefix, order(i)))[:cap], key=order)


def test_tiers_match_restatement(spark):
    rng = random.Random(11)
    words = ["ab", "abc", "a & b", "& ab", "abc &", "ab  c", "x", "abcd", "the", "the &co"]
    raw = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    rows = [(f"k{i:03d}", clean(r)) for i, r in enumerate(raw)]
    names, weight = dict(rows), {k: rng.randrange(9) for k, _ in rows}
    df = spark.createDataFrame([(k, nm, weight[k]) for k, nm in rows], "key string, nm string, n int")
    order = [F.col("n").desc(), F.col("nm"), F.col("key")]
    for cap, depth in ((3, 10), (20, 6), (1, 4)):
        want = by_level(rows, cap, depth)
        got = {}
        for r in search.prefix_index(df, "nm", order, ["key"], cap, depth).collect():
            got.setdefault((r["prefix"], r["total"]), []).append((r["rank"], r["key"]))
        assert {p: t for p, t in got} == {p: len(ids) for p, ids in want.items()}
        for (p, _), hits in got.items():
            assert [k for _, k in sorted(hits)] == head(want[p], p, names, weight, cap)


def test_exact_name_is_always_in_its_head(spark):
    rows = [("kabc", "abc", 1)] + [(f"k{i}", f"abcxx{i}", 100 - i) for i in range(5)]
    df = spark.createDataFrame(rows, "key string, nm string, n int")
    heads = search.prefix_index(df, "nm", [F.col("n").desc(), F.col("key")], ["key"], cap=3)
    abc = heads.filter("prefix = 'abc'").orderBy("rank").collect()
    assert [r["key"] for r in abc] == ["k0", "k1", "kabc"] and abc[0]["total"] == 6


def test_search_probes_longest_first(spark):
    entries = spark.createDataFrame(
        [(f"amazon {i}", f"k{i}", None, f"Amazon {i}", 9 - i) for i in range(5)]
        + [("zz", "kz", "941156497", "ZZ", 0)],
        "nm string, key string, ein string, name string, n_filings int",
    )
    docs = documents.employer_search_documents(search.employer_index(entries, cap=4))
    asked = spark.createDataFrame(
        [(1, "Amazing"), (2, "amaz"), (3, "x"), (4, "qq"), (5, "ZZ top"), (6, "Amazing")],
        "request_id int, q string",
    )
    got = {r["request_id"]: r for r in lookup.search(docs, asked).collect()}
    assert {i: (r["status"], r["hit"]) for i, r in got.items()} == {
        1: (200, "ama"), 2: (200, "amaz"), 3: (400, None), 4: (404, None), 5: (200, "zz"),
        6: (200, "ama"),
    }
    body = json.loads(got[5]["body"])
    assert body == {"prefix": "zz", "total": 1, "results": [
        {"id": "kz", "ein": "941156497", "name": "ZZ", "n_filings": 0}]}
    reach = search.reachability(search.employer_index(entries, cap=4), entries).collect()[0]
    assert (reach["n_entries"], reach["n_reachable"]) == (6, 6)


def test_lookup_statuses(spark):
    docs = spark.createDataFrame(
        [("profile", "e/941156497.json", "{}"), ("wages", "w/15-1252/NA.json", "[]"),
         ("jobs", "e/941156497/jobs.json", "j"), ("meta", "meta.json", "m")],
        "family string, key string, body string",
    )
    asked = spark.createDataFrame(
        [(1, "94-1156497"), (2, "<script>"), (3, "n-00")], "request_id int, id string")
    got = {r["request_id"]: (r["status"], r["body"]) for r in
           lookup.lookup_entity(docs, asked).collect()}
    assert got == {1: (200, "{}"), 2: (400, None), 3: (404, None)}
    jobs = lookup.lookup_entity(docs, asked, "jobs").collect()
    assert [(r["request_id"], r["status"], r["body"]) for r in jobs if r["body"]] == [(1, 200, "j")]
    wages = spark.createDataFrame(
        [(1, "bad", "II"), (2, "15-1252", "V"), (3, "15-1252", "na"), (4, "15-1252", "I")],
        "request_id int, soc string, level string")
    got = {r["request_id"]: r["status"] for r in lookup.lookup_wages(docs, wages).collect()}
    assert got == {1: 400, 2: 400, 3: 200, 4: 404}
    assert lookup.lookup_meta(docs, wages.limit(1)).collect()[0]["body"] == "m"


def test_titles_are_cleaned_once(spark):
    """The first met spelling and its sum as row by row; cleaning comes after titles have met."""
    rows = [("k2", "a", "Data  Clerk", 5), ("k1", "a", "data clerk", 2), ("k1", "a", "DATA CLERK", 2),
            ("k1", "b", "Data Clerk", 9), ("k0", "a", "Welder", 1), ("k3", "a", "data clerk", 7)]
    titles = spark.createDataFrame(rows, "key string, soc_code string, title string, n_filings long").repartition(3)
    corpus = search.title_corpus(titles)
    assert {tuple(r) for r in corpus.select("nm", "soc_code", "title", "n").collect()} == {
        ("data clerk", "a", "DATA CLERK", 16), ("data clerk", "b", "Data Clerk", 9), ("welder", "a", "Welder", 1)}
    plan = corpus._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan[plan.rindex("Exchange hashpartitioning(title"):]
