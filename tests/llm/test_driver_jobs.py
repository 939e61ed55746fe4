"""Connected components and near copies run no job on what is settled already."""

import numpy as np
import pytest

from docketlake.llm import components as stars
from docketlake.llm import simhash


def written(monkeypatch, module):
    names, real = [], module.materialize

    def watched(df, name):
        names.append(name)
        return real(df, name)
    monkeypatch.setattr(module, "materialize", watched)
    return names


def test_edges_of_one_task_take_no_round(spark, monkeypatch):
    names = written(monkeypatch, stars)
    edges = [(k + 1, k) for k in range(300)] + [(1000, 1005), (1005, 1002), (7, 7), (2000, 2000)]
    rows = stars.components(spark.createDataFrame(edges, "a long, b long").coalesce(1)).collect()
    want = {(k, 0) for k in range(1, 301)} | {(1002, 1000), (1005, 1000)}
    assert sorted(map(tuple, rows)) == sorted(want) and names == ["edges"]


@pytest.mark.parametrize("run", [1 << 20, 3])
def test_chains_across_tasks(spark, monkeypatch, run):
    monkeypatch.setattr(stars, "RUN", run)
    rng = np.random.default_rng(2)
    name = rng.permutation(400)
    edges = [(int(name[k]), int(name[k + 1])) for k in range(399) if k % 100 != 99]
    rows = stars.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    want = {int(n): int(name[k // 100 * 100 : k // 100 * 100 + 100].min()) for k, n in enumerate(name)}
    assert {r["node"]: r["root"] for r in rows} == {n: r for n, r in want.items() if n != r}
    assert len(rows) == len({r["node"] for r in rows})
    assert stars.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_round_without_links_is_the_last(spark, monkeypatch):
    names = written(monkeypatch, simhash)
    base = [" ".join(f"t{k}w{i}" for i in range(60)) for k in range(4)]
    rows = base + [f"{t} more" for t in base] + [" ".join(t.split()[:-3]) for t in base]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.near_copies(docs).collect()} == set(range(4))
    assert names.count("pairs") <= 2 and names.count("roots") == 1 and names.count("known") == 1
