"""Near copies in large groups of variants: exact groups without a row for each pair."""

import numpy as np
import pytest

from docketlake.llm import simhash
from docketlake.llm.components import local_roots
from tests.llm.test_pipeline import edited, near_pairs


def variants():
    """A text of 150 words in many variants, some near to others alone, and unlike texts."""
    rng = np.random.default_rng(5)
    base = " ".join(f"v{i}" for i in rng.integers(0, 400, 150))
    rows = [base] + [edited(rng, base, k / 150) for k in (1, 2, 3, 4, 6) for _ in range(60)]
    rows += [edited(rng, rows[-k], 0.01) for k in range(1, 30)]
    rows += [" ".join(f"u{i}" for i in rng.integers(0, 400, 60)) for _ in range(40)]
    pairs = near_pairs(rows)
    return rows, local_roots(len(rows), *(np.array(x, int) for x in zip(*pairs))), pairs


def test_groups_are_exact_and_no_table_holds_all_pairs(spark, monkeypatch):
    rows, root, pairs = variants()
    want = {i for i in range(len(rows)) if root[i] == i}
    assert len(pairs) > 10 * len(rows) and 60 < len(want) < 200
    written, real = {}, simhash.materialize

    def watched(df, name):
        out = real(df, name)
        written.setdefault(name, []).append(out.count())
        return out
    monkeypatch.setattr(simhash, "materialize", watched)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.near_copies(docs).collect()} == want
    texts = max(written["distinct-texts"])
    assert max(n for name, counts in written.items() for n in counts if "bucket" not in name and name not in (
        "shared-keys", "known", "largest", "parts", "own-shingles")) <= 2 * texts
    assert max(max(counts) for counts in written.values()) <= simhash.BANDS * texts


@pytest.mark.parametrize("limit", [600, 10**9])
def test_parts_of_a_bucket_meet(spark, limit):
    """All links between groups are found, also when one bucket is many cells."""
    rows, root, _ = variants()
    some = [simhash._set(t.encode()) for t in rows]
    sets = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in enumerate(some)], "node long, set array<long>")
    known = spark.createDataFrame([(1, i, len(s), i, len(s)) for i, s in enumerate(some)],
                                  "key long, node long, n int, root long, held long")
    links = simhash._apart(known, sets, simhash.SIMILARITY, limit).collect()
    assert (local_roots(len(rows), *(np.array(x, int) for x in zip(*links))) == root).all()


def test_keys_are_shared_by_near_sets():
    rng = np.random.default_rng(3)
    lost = 0
    for _ in range(200):
        a = rng.integers(0, 1 << 63, 90, np.uint64)
        b = np.concatenate([a[10:], rng.integers(0, 1 << 63, 10, np.uint64)])  # similarity 0.8
        lost += not (simhash.band_keys(a) == simhash.band_keys(b)).any()
    assert lost == 0
    assert (simhash.band_keys(a[:0]) == simhash.band_keys(b[:0])).all()
