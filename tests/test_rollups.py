"""Distinct entities per tier."""

import random

from pyspark.sql import functions as F

from docketlake.operators import rollups


def made(spark, n=3000, seed=2):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), rng.choice(["CA", "NY", None]), rng.choice(["1", "2", "3", None]),
             rng.choice([None, *(f"e{k}" for k in range(40))])) for _ in range(n)]
    rows += [("a", "CA", "1", "hot")] * n + [("c", "NY", "1", None)]
    return rows, spark.createDataFrame(rows, "soc string, state string, zip string, key string")


def test_distinct_entities_of_every_tier(spark):
    rows, df = made(spark)
    want = {}
    for soc, state, zip_, key in rows:
        for depth, cell in enumerate(((None, None), (state, None), (state, zip_))):
            want.setdefault((soc, *cell, depth), set()).update([key] if key is not None else [])
    got = rollups.tiered_entities(df, ["soc"], ["state", "zip"], "key", "n").collect()
    assert {(r["soc"], r["state"], r["zip"], r["depth"]): r["n"] for r in got} == {k: len(v) for k, v in want.items()}


def test_entities_are_moved_once(spark):
    """One exchange with entity keys, at the finest tier; the other one moves counted cells."""
    _, df = made(spark, 10)
    plan = rollups.tiered_entities(df, ["soc"], ["state", "zip"], "key", "n")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 2 and "key#" not in exchanges[0] and "key#" in exchanges[1]
    assert "count" in plan and "Expand" not in plan


def test_facets_of_an_entity(spark):
    """Totals, years and codes against plain loops; NULL codes, years and sums included."""
    rng = random.Random(7)
    cells = {(f"e{rng.randrange(40)}", rng.choice([None, "a", "b", "c"]), rng.choice([None, 2001, 2002, 2003])):
             (rng.randrange(9), rng.choice([None, 1, 2])) for _ in range(500)}
    cells[("uncoded", None, 2001)] = (5, None)
    df = spark.createDataFrame(
        [(*k, *v) for k, v in cells.items()], "key string, soc string, year int, n long, m long").repartition(5)

    def total(rows, i):
        known = [r[i] for r in rows if r[i] is not None]
        return sum(known) if known else None

    def by(rows, i):
        groups = {}
        for k, v in rows:
            groups.setdefault(k[i], []).append((k, v))
        return sorted(groups.items(), key=lambda g: (g[0] is not None, g[0]))

    got = {r["key"]: r for r in rollups.entity_facets(df, "key", "soc", "year", {"measures": ["n"]}).collect()}
    entities = dict(by(cells.items(), 0))
    assert set(got) == set(entities)
    for key, rows in entities.items():
        r, values = got[key], [v for _, v in rows]
        years = [(y, total([v for _, v in g], 0), total([v for _, v in g], 1)) for y, g in by(rows, 2)]
        assert tuple(r["totals"]) == (total(values, 0), total(values, 1))
        assert [tuple(y) for y in r["by_year"]] == years
        assert (r["first_year"], r["last_year"]) == (years[0][0], years[-1][0])
        codes = [(code, [(y, total([v for _, v in h], 0)) for y, h in by(g, 2)], (total([v for _, v in g], 0),))
                 for code, g in by(rows, 1) if code is not None]
        assert [(c["code"], [tuple(s) for s in c["series"]], tuple(c["totals"])) for c in r["by_code"]] == codes


def test_facets_sort_cells_once(spark):
    """No cell is doubled and no list of a group is kept in a hash table."""
    df = spark.createDataFrame([("e", "a", 2001, 1)], "key string, soc string, year int, n long").repartition(3)
    facets = rollups.entity_facets(df, "key", "soc", "year", {"measures": ["n"]})
    plan = facets._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashAggregate" not in plan
    assert plan.count("SortAggregate") == 2 and plan.count("Sort [") == 1
