"""Exact percentiles and tiers against brute force, with a dominating group."""

import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from docketlake.operators.percentiles import coarse_bucket, grouped_percentiles, value_counts
from docketlake.operators.rollups import tiered_benchmarks
from docketlake.session import materialize

PROBS = {"p25": "0.25", "p50": "0.50", "p75": "0.75"}


def exact(values, p):
    values, spot = sorted(values), Decimal(p) * (len(values) - 1)
    low = int(spot)
    high = min(low + 1, len(values) - 1)
    v = values[low] + (values[high] - values[low]) * (spot - low)
    return v.quantize(Decimal("0.01"), ROUND_HALF_UP)


def data():
    rng = random.Random(5)
    rows = [("hot", Decimal(rng.randrange(-10**6, 10**8)) / 1000) for _ in range(4000)]
    rows += [("same", Decimal("7.505"))] * 500 + [(None, Decimal(3)), (None, Decimal("4.01"))]
    rows += [(f"g{rng.randrange(60)}", Decimal(rng.randrange(10**5)) / 100) for _ in range(900)]
    return rows


def test_percentiles_match_brute_force(spark):
    rows = data()
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    want = {g: (len(v), *[exact(v, p) for p in PROBS.values()]) for g, v in groups.items()}
    df = spark.createDataFrame(rows, "g string, v decimal(20,5)")
    hist = value_counts(df, ["g"], "v")
    for stored in (hist, materialize(hist, "histogram")):
        got = grouped_percentiles(stored, ["g"], "v", PROBS).collect()
        assert {r["g"]: (r["n"], r["p25"], r["p50"], r["p75"]) for r in got} == want


def test_bucket_is_monotone(spark):
    values = [-1e27, -500.0, -1.0, -0.01, 0.0, 0.01, 1.0, 15.0, 15.01, 1e5, 1e5 + 0.01, 1e27]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(coarse_bucket(F.col("v"))).collect()]
    assert got == sorted(got) and max(map(abs, got)) < 5000


def test_tiers_keep_rolled_up_and_missing_places_apart(spark):
    rows = [("x", "CA", "1", 10, "a")] * 5 + [("x", "CA", None, 20, "b")]
    rows += [("x", None, "2", 30, "c")] * 6 + [("x", "NY", "3", 40, "a")] * 4
    df = spark.createDataFrame(rows, "soc string, st string, zip string, w int, k string")
    df = df.withColumn("w", F.col("w").cast("decimal(20,5)"))
    got = tiered_benchmarks(df, ["soc"], ["st", "zip"], "w", "w", "w", "k").collect()
    cells = {(r["depth"], r["st"], r["zip"]): (r["n_filings"], r["employer_count"]) for r in got}
    assert cells == {
        (0, None, None): (16, 3), (1, "CA", None): (6, 2), (1, "NY", None): (4, 1),
        (2, "CA", "1"): (5, 1), (2, None, "2"): (6, 1),  # a zip without a state stays
    }
