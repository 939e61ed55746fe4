"""Candidates for near copies: every pair within the radius, however many are nearer."""

import numpy as np
from pyspark.sql import functions as F

from docketlake.llm import simhash


def brute(rows):
    found = set()
    for i, (a, fp, far) in enumerate(rows):
        for b, other, beyond in rows[i + 1:]:
            near = (fp ^ other).bit_count() <= simhash.WIDE and (far ^ beyond).bit_count() <= simhash.FAR
            found |= {(min(a, b), max(a, b))} if near else set()
    return found


def planted(n=60):
    """Fingerprints around one, in few bits each, several texts of some, and unlike ones."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(n):
        fp, far = 0x0123456789ABCDEF, 0x0F1E2D3C4B5A6978
        for bit in rng.choice(63, k % 5, replace=False):
            fp ^= 1 << int(bit)
        for bit in rng.choice(63, (3 * k) % 29, replace=False):
            far ^= 1 << int(bit)
        rows.append((k, fp, far))
    return rows + [(n + k, int(rng.integers(1 << 62)), int(rng.integers(1 << 62))) for k in range(40)]


def test_no_candidate_is_crowded_out(spark):
    rows = planted()
    want = brute(rows)
    assert len(want) > 300  # far more than two a text
    texts = spark.createDataFrame(rows, "node long, fp long, far long")
    assert {tuple(r) for r in simhash._candidates(texts).collect()} == want


def test_parts_of_a_crowded_shard_meet(spark):
    rows = planted()
    fps = {a: fp for a, fp, _ in rows}
    want = {(a, b) for a, b in brute(rows) if fps[a] != fps[b]}
    texts = spark.createDataFrame(rows, "node long, fp long, far long")
    found = simhash.near_links(texts, limit=8).groupBy("a", "b").agg(F.count("*"))
    assert {(r["a"], r["b"]) for r in found.collect()} == want


def test_blocks_do_not_lose_pairs(monkeypatch):
    rows = planted()
    monkeypatch.setattr(simhash, "FRONTIER", 7)
    node, fp, far = (np.array(x, np.int64) for x in zip(*rows))
    got = set()
    for a, b in simhash.near_pairs(np.zeros(len(fp), np.int64), fp, np.zeros(len(fp), bool), far, simhash.WIDE):
        got |= {(min(p), max(p)) for p in zip(node[a].tolist(), node[b].tolist())}
    assert got == {(a, b) for a, b in brute(rows) if fp[a] != fp[b]}
