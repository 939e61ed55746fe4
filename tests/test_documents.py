"""Documents streamed from sorted runs, their pieces, and the store in buckets."""

import hashlib
import json
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketlake.operators import lookup
from docketlake.plans import documents, streamed
from docketlake.plans.streamed import Section
from docketlake.sources import tables as store

SECTIONS = [Section("list"), Section("places", by_place=True), Section("others", by_place=True)]


def batch(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()))],
        ["key", "head", "section", "place", "text"])


def pieces(rows, piece=1 << 20, size=7):
    batches = [batch(rows[k : k + size]) for k in range(0, len(rows), size)]
    return [r for b in streamed.render(iter(batches), SECTIONS, piece) for r in b.to_pylist()]


@pytest.mark.parametrize("piece", [1, 30, 1 << 20])
def test_rows_become_json(piece):
    rng, rows, want = random.Random(1), [], {}
    for key in ("a", "b", "ccc", "d"):
        head = {} if key == "b" else {"id": key, "n": None}
        doc = {**head, "list": [], "places": {}, "others": {}}
        for k in range(rng.randint(0, 12)):
            rows.append((key, json.dumps(head, separators=(",", ":")), 0, None, json.dumps(k)))
            doc["list"].append(k)
        for section, name in ((1, "places"), (2, "others")):
            for place in rng.sample(["CA", "N\"Y", "TX"], rng.randint(key == "d", 3)) if key != "ccc" else []:
                for k in range(rng.randint(1, 4)):
                    rows.append((key, json.dumps(head, separators=(",", ":")), section, json.dumps(place), '{"k":%d}' % k))
                    doc[name].setdefault(place, []).append({"k": k})
        if any(r[0] == key for r in rows):
            want[key] = json.dumps(doc, separators=(",", ":"))
    got = {}
    for r in pieces(rows, piece):
        body = got.setdefault(r["key"], [])
        assert r["piece"] == len(body)
        body.append(r)
    assert {k: "".join(r["body"] for r in v) for k, v in got.items()} == want
    for k, v in got.items():
        assert [r["sha256"] for r in v[:-1]] == [None] * (len(v) - 1)
        assert v[-1]["sha256"] == hashlib.sha256(want[k].encode()).hexdigest() and v[-1]["n_bytes"] == len(want[k].encode())


def test_memory_does_not_grow_with_a_document():
    row = json.dumps({"soc_code": "15-1252", "title": "x" * 80})

    def rows(n):
        for _ in range(0, n, 1000):
            yield batch([("k", '{"id":"k"}', 0, None, row)] * 1000)

    peaks = []
    for n in (20_000, 200_000):
        tracemalloc.start()
        total = sum(b.num_rows for b in streamed.render(rows(n), SECTIONS, 1 << 18))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert total > n // 3000
    assert peaks[1] < 1.5 * peaks[0] + 1e6


def jobs(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("n-"), (F.col("id") % 3).cast("string")).alias("key"), (2000 + F.col("id") % 7).cast("int").alias("year"),
        F.concat(F.lit("15-"), F.col("id")).alias("soc_code"), F.lit("II").alias("level"),
        *[F.lit(1.5).cast("decimal(12,2)").alias(c) for c in ("avg_wage", "min_wage", "max_wage", "avg_prev_wage")],
        F.lit("CA").alias("state"), F.lit(None).cast("string").alias("county"), F.lit("94043").alias("zip"),
        F.lit(1).cast("long").alias("n_filings"))


def test_pieces_in_order_are_the_document(spark, monkeypatch):
    whole = {r["key"]: r for r in documents.jobs_documents(jobs(spark, 900)).collect()}
    monkeypatch.setattr(streamed, "PIECE", 5000)
    cut = documents.jobs_documents(jobs(spark, 900))
    parts = {}
    for r in sorted(cut.collect(), key=lambda r: (r["key"], r["piece"])):
        parts.setdefault(r["key"], []).append(r)
    assert all(len(v) > 5 for v in parts.values())
    for k, v in parts.items():
        assert "".join(r["body"] for r in v) == whole[k]["body"]
        assert (v[-1]["sha256"], v[-1]["n_bytes"]) == (whole[k]["sha256"], whole[k]["n_bytes"])
        years = [j["year"] for j in json.loads(whole[k]["body"])["jobs"]]
        assert years == sorted(years, reverse=True)
    assert documents.digests(cut).count() == 3


def test_documents_collect_no_rows(spark):
    for docs in (documents.jobs_documents(jobs(spark, 9)),):
        plan = docs._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and plan.count("Exchange") == 1 and "Sort" in plan


def files_read(spark):
    """Files that the scans of the last queries opened, by their own metric."""
    shown = spark._jsparkSession.sharedState().statusStore()
    found, runs = [], shown.executionsList()
    for k in range(runs.size()):
        run = runs.apply(k)
        values = shown.executionMetrics(run.executionId())
        for j in range(run.metrics().size()):
            metric = run.metrics().apply(j)
            if metric.name() == "number of files read" and values.contains(metric.accumulatorId()):
                found.append((run.executionId(), int(values.apply(metric.accumulatorId()).replace(",", ""))))
    return found


def test_a_lookup_opens_only_the_wanted_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = spark.range(4000).select(
        F.lit("profile").alias("family"), F.format_string("e/%09d.json", F.col("id")).alias("key"), F.lit(0).alias("piece"),
        F.lit("{}").alias("body"), F.lit("x").alias("sha256"), F.lit(2).cast("long").alias("n_bytes"))
    store.write_documents(docs, path, buckets=8)
    assert store.bucket_count(spark, path) == 8
    saved = store.read_documents(spark, path)
    asked = spark.createDataFrame([(1, "000000007"), (2, "bad"), (3, "999999999")], "request_id int, id string")
    one = asked.filter("request_id < 3")
    got = lookup.lookup_entity(saved, one, "profile", 8).collect()
    assert sorted((r["request_id"], r["status"], r["body"]) for r in got) == [(1, 200, "{}"), (2, 400, None)]
    run, files = files_read(spark)[-1]
    assert files == 1
    every = lookup.lookup_entity(saved, asked, "profile", 8).collect()
    assert sorted((r["request_id"], r["status"]) for r in every) == [(1, 200), (2, 400), (3, 404)]
    assert lookup.lookup_entity(saved, asked, "profile").count() == 3
    assert store.existing_keys(spark, path).count() == 4000


def test_buckets_follow_the_number_of_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "DOCUMENTS", 2)
    path = str(tmp_path / "store")
    store.write_documents(documents.jobs_documents(jobs(spark, 9)), path)
    assert store.bucket_count(spark, path) == 2


def test_families_are_written_one_after_another(spark, tmp_path):
    """The store is that of all documents at once."""
    frames = [documents.jobs_documents(jobs(spark, 30)), documents.seal(spark.createDataFrame(
        [("meta", "meta.json", "{}"), ("meta", "other.json", "[]")], "family string, key string, body string"))]
    for path, docs in (("one", frames[0].unionByName(frames[1])), ("two", frames)):
        store.write_documents(docs, str(tmp_path / path), buckets=3)
    one, two = (store.read_documents(spark, str(tmp_path / path)) for path in ("one", "two"))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and two.count() == 5
    assert store.bucket_count(spark, str(tmp_path / "two")) == 3
    store.write_documents(frames[1:], str(tmp_path / "two"))  # replaces all families
    assert store.read_documents(spark, str(tmp_path / "two")).count() == 2
