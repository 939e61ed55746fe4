"""The trie of conversations against brute force; the whole tables against SQL are in test_oracle."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from docketlake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key int, words string"


def brute(rows):
    own = {}
    for c, turn, role, text in sorted((r[:4] for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        below = [out[q] for q in children.get(p, [])]
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if seqs[c] == p))
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below),
                  sum(b[5] for b in below) or 1, (len(members[p]) - 1) * words + sum(b[6] for b in below),
                  hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def found(spark, rows):
    turns = spark.createDataFrame([(*r[:4], 1, "x") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt(turns)).collect()), key=str)


def made(seed, convs, longest, texts=("a b", "c", "d e f", None)):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * convs), convs):
        for k in range(rng.randint(1, longest)):
            rows.append((c, None if k == 0 and rng.random() < 0.2 else k, rng.choice(["user", None]), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, convs, longest, parts", [(1, 40, 5, 4), (2, 120, 3, 13), (3, 30, 40, 7)])
def test_any_conversations(spark, seed, convs, longest, parts):
    rows = made(seed, convs, longest)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TURNS", 5)
    rows = [(20, 0, "u", "same"), (20, 1, "u", "same")]  # repeated turns
    rows += [(c, 0, "u", "one very common turn") for c in range(21, 60)]  # equal conversations
    rows += [(61, k, "u", "") for k in range(1500)] + [(62, k, "u", "") for k in range(1400)]  # long, one begins the other
    rows += [(100, 3, None, None), (105, 0, "u", "lost"), (None, 0, "u", "no conversation"), (7, None, "u", "long " * 50000)]
    assert found(spark, rows) == brute(rows)


def test_ties_have_one_result(spark):
    rows = [(c, 1, "u", t) for c in (4, 44) for t in ("x", "y", "z")]
    assert found(spark, rows) == found(spark, rows[::-1])


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "u", "x")]) == []


def test_every_merge_makes_a_branching_node():
    import numpy as np
    seq = lambda *turns: np.array([x for t in turns for x in (t, t)], np.int64)
    sequences = [seq(), seq(1), seq(1, 2), seq(1, 2, 3), seq(1, 4), seq(5)]
    words = [[1] * (len(s) // 2) for s in sequences]
    trie, leaf = prefix_trie.forest(sequences, words, list(range(6)), [1] * 6, ["e"] * 6)
    nodes = {trie.now(k) for k in range(len(trie.conv))}
    assert sorted((trie.depth[k], trie.n[k], trie.children[k], trie.leaves[k], trie.saved[k]) for k in nodes) == [
        (0, 6, 2, 3, 4), (1, 1, 0, 1, 0), (1, 4, 2, 2, 4), (2, 1, 0, 1, 0), (2, 2, 1, 1, 1), (3, 1, 0, 1, 0)]


def test_hash_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = spark.range(100).select((F.col("id") % 3).alias("p"), F.lit(0).cast("long").alias("q"), F.col("id").alias("conv_id"))
    got = {r["p"]: r["ends_sha256"] for r in prefix_trie._ends(rows).collect()}
    assert got == {p: hashlib.sha256(",".join(map(str, range(p, 100, 3))).encode()).hexdigest() for p in range(3)}
