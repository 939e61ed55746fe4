"""BPE against the tokenizers library, packing against plain best-fit decreasing, rollups."""

import bisect
import hashlib
import os
import unicodedata
import zlib

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docketlake.llm import bpe, packing, token_rollup
from docketlake.llm.queries import tokenizer_file

ODD = [
    "", None, "Hello  World's it'll 123 4½ ²", "a\x1cb\x85c\xa0d　e​f", "ÉCOLE é ΣΑΣ İstanbul ǅ",
    "<|endoftext|>x<|startoftext|> <|EndOfText|> <|", "日本語テキスト ไทย हिन्दी", "x" * 300 + "yz" * 500,
    "'S 'T don'T ''s", "a_b __ -- #@! 😀👍🏽", "ß ﬁ Ⅷ", "\x00\x01﻿", "A" * 47, "b" * 48 + "é", " \n\t ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_file())


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(tokenizer_file())


def test_encode_and_decode_as_the_library(library, own):
    ids, ends = own.encode(pa.array([t or "" for t in ODD]))
    for text, got in zip(ODD, np.split(ids, ends[:-1])):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got.tolist() == want, text
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn", "Co"]), max_size=80))
def test_any_text_as_the_library(library, own, text):
    assert own.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_code_point_as_the_library(library, own):
    """All of Unicode: between letters, before and behind marks of several classes, and after each other."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    marks = [c for c in points if unicodedata.combining(c)]
    texts = [f"a{c}b {c}{c} a{c}" for c in points]
    texts += [f"{x}{m}{c}x {x}{c}{m}x" for c in marks for m in "\u0301\u0316\u0334\u0345\u1dfa" for x in "ae"]
    texts += ["\U00011935\U00011930", "\U00011938", "a\u1abf\u0301\u0316"]
    for start in range(0, len(texts), 20_000):
        part = texts[start : start + 20_000]
        ids, ends = own.encode(pa.array(part))
        want = [e.ids for e in library.encode_batch_fast(part, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == want


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_unassigned_text_as_the_library(library, own, text):
    assert own.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_very_long_text(library, own):
    text = "Längere Wörter 123 und ein sehr " * 30_000 + "x" * 100_000
    assert own.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet="abeinrst", min_size=1, max_size=60))
def test_heap_and_scan_agree(own, word):
    raw = np.frombuffer(word.encode(), np.uint8)
    parts = own.inner[raw]
    parts[-1] = own.final[raw[-1]]
    done, size = own._scan(parts[None, :].copy())
    assert own._heap(parts.tolist()) == done[0][: size[0]].tolist()


def test_columns(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens string")
    rows = docs.select("doc_id", bpe.encode(tokenizer_file(), "text").alias("ids"), bpe.count(tokenizer_file(), "text").alias("n"))
    rows = rows.withColumn("back", bpe.decode(tokenizer_file(), "ids"))
    trips = {r["doc_id"]: r["_trip"] for r in bpe.round_trip(docs, tokenizer_file()).collect()}
    for r in rows.collect():
        want = library.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        assert (r["ids"], r["n"], r["back"]) == (want, len(want), text)
        assert trips[r["doc_id"]] == (
            len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(none, tokenizer_file()).count() == 0
    assert packing.packed(none, tokenizer_file()).count() == 0


# --- packing -------------------------------------------------------------------


def plain_bins(lengths, capacity):
    """How many bins best-fit decreasing opens, one piece at a time."""
    bins, opened = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(bins, n)
        room = bins.pop(at) if at < len(bins) else capacity
        opened += room == capacity and at >= len(bins)
        if room > n:
            bisect.insort(bins, room - n)
    return opened


@settings(deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_plan_is_best_fit_decreasing(lengths):
    counts = [(n, lengths.count(n)) for n in set(lengths)]
    steps = packing.plan(counts, 40)
    used = {}
    for n, first, last, start, each, offset in steps:
        for i in range(last - first):
            used.setdefault(start + i // each, []).append((offset + i % each * n, n))
    for places in used.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end = at + n
        assert end <= 40
    assert sorted(n for p in used.values() for _, n in p) == sorted(lengths)
    assert sorted(used) == list(range(len(used)))
    # equal pieces may be taken together, which never needs more bins than one by one
    assert len(used) <= plain_bins(lengths, 40)


def test_capacity_tree():
    tree = packing.Capacities(10)
    assert tree.tightest(1) == -1
    tree.add(4, 1)
    tree.add(10, 2)
    assert [tree.tightest(n) for n in (1, 4, 5, 10)] == [4, 4, 10, 10]
    tree.add(10, -2)
    assert tree.tightest(5) == -1


def test_packed_documents(spark, library):
    texts = [(0, "word " * 30), (1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (4, "one two three " * 20)]
    docs = spark.createDataFrame([(*t, 9) for t in texts], "doc_id long, text string, piece int")
    rows = packing.packed(docs, tokenizer_file(), capacity=16).collect()
    want = []
    for key, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 16)):
            part = np.array(ids[at : at + 16], "<u4")
            want.append((key, k, at, len(part), zlib.crc32(part.tobytes())))
    order = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted([tuple(r)[:5] for r in rows], key=order) == sorted(want, key=order)
    assert len({r["sequence_id"] for r in rows}) == plain_bins([w[3] for w in want], 16)
    for s in {r["sequence_id"] for r in rows}:
        end = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 16


# --- rollups -------------------------------------------------------------------


def _changes(spark, rows):
    kind = "struct<source: string, lang: string, version: string, n_tokens: bigint, n_bytes: bigint>"
    return spark.createDataFrame(rows, f"op string, before {kind}, after {kind}")


def _totals(rollup):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}


def test_rollup_commits_once_and_compacts(spark, tmp_path):
    a, b = ("s", "en", "v", 5, 50), ("s", None, "v", 7, None)
    rollup = token_rollup.Rollup(spark, str(tmp_path))
    assert _totals(rollup) == {}
    load = _changes(spark, [("insert", None, a), ("insert", None, a), ("insert", None, b), ("delete", None, None)])
    assert rollup.commit("load", load) and not rollup.commit("load", load)
    assert _totals(rollup) == {("s", "en", "v"): (2, 10, 100), ("s", None, "v"): (1, 7, 0)}
    fix = _changes(spark, [("revise", a, ("s", "de", "v", 6, 60)), ("delete", b, None)])
    assert rollup.commit("fix", fix)
    want = {("s", "en", "v"): (1, 5, 50), ("s", "de", "v"): (1, 6, 60), ("s", None, "v"): (0, 0, 0)}
    assert _totals(rollup) == want
    assert rollup.compact("all")
    assert _totals(rollup) == {k: v for k, v in want.items() if any(v)}
    assert not rollup.commit("fix", fix) and not rollup.commit("all", fix)
    assert rollup.batches() == ["all"]
    assert rollup.commit("later", _changes(spark, [("delete", a, None)])) and rollup.compact("more")
    assert _totals(rollup) == {("s", "de", "v"): (1, 6, 60)} and not rollup.commit("load", load)
    with pytest.raises(ValueError):
        rollup.commit("a/b", fix)


def test_interrupted_commit_counts_nothing(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, str(tmp_path))
    batch = _changes(spark, [("insert", None, ("s", "en", "v", 5, 50))])
    token_rollup.deltas(batch).write.parquet(str(tmp_path / "aside" / "left-over" / "sums"))
    assert _totals(rollup) == {}
    assert rollup.commit("load", batch)
    assert _totals(rollup) == {("s", "en", "v"): (1, 5, 50)}


def test_word_count(spark):
    rows = spark.createDataFrame([("a b c\x1cd\n",), ("",), (None,)], "text string")
    assert [r[0] for r in rows.select(token_rollup.words("text")).collect()] == [2, 0, None]


def test_rollup_query_against_the_final_state(spark, library):
    from docketlake.llm.queries import op8_token_rollup

    sf = "/root/testdata/sf0.001"
    want = {}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").collect()}
    groups = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = "\n".join(dict.fromkeys(r["text"].split("\n")))
        for version, n in (("words", len(text.encode().split())),
                           ("word_bpe_49k", len(library.encode(text, add_special_tokens=False).ids))):
            key = (r["source"], r["lang"], version)
            groups.add(key)
            if r["doc_id"] not in toxic:
                want[key] = tuple(map(sum, zip(want.get(key, (0, 0, 0)), (1, n, len(text.encode())))))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in op8_token_rollup(spark, sf).collect()}
    assert got == {k: want.get(k, (0, 0, 0)) for k in groups}


def test_one_length_for_most_pieces_takes_many_runs(spark, monkeypatch):
    """Numbering in runs packs as numbering in one does."""
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        F.when(F.col("id") % 10 < 8, 4096).otherwise(F.col("id") % 50 + 1).cast("long").alias("length"),
        F.col("id").alias("ids_crc32"))
    packs = []
    for numbered in (10**6, 40):
        monkeypatch.setattr(packing, "NUMBERED", numbered)
        got = packing.pack(rows).collect()
        bins = {}
        for r in got:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in bins.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
            assert sum(n for _, n in parts) <= 4096
        packs.append((len(got), len(bins)))
    assert packs[0] == packs[1]
