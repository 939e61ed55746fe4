"""Resolution without moving filings that have an identifier; refreshes move only what changed."""

from pyspark.sql import functions as F

from docketlake.operators import identity
from docketlake.session import materialize

ROWS = [
    (1, "acme", "941156497"), (2, "acme", None), (3, "acme", None), (4, "solo", None), (5, None, "130000001"),
    (6, "twice", None), (7, "twice", "200000001"), (8, "twice", "200000002"), (9, None, None),
]


def filings(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id int, nm string, ein string")


def keys(df):
    return {r["id"]: r["key"] for r in df.collect()}


def id_map(spark, rows=ROWS):
    return identity.name_id_map(identity.name_votes(filings(spark, rows)))


def test_keys(spark):
    got = keys(identity.resolve(filings(spark), id_map(spark)))
    assert got[1] == got[2] == got[3] == "941156497"
    assert got[4].startswith("n-") and got[6] == got[7] == "200000001" and got[8] == "200000002"
    assert set(got) == {1, 2, 3, 4, 6, 7, 8}


def test_filings_with_an_identifier_pass_no_exchange(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(before, ("-1", "false")):
        spark.conf.set(k, v)
    try:
        stored, known = materialize(filings(spark), "filings"), materialize(id_map(spark), "map")
        plan = identity.resolve(stored, known)._jdf.queryExecution().executedPlan().toString()
        union = plan[plan.index("Union"):].splitlines()
        branches = [k for k, line in enumerate(union) if line.startswith((":-", "+-"))]
        own, joined = "\n".join(union[branches[0]:branches[1]]), "\n".join(union[branches[1]:])
        assert "Exchange" not in own and "isnotnull(ein" in own
        assert joined.count("Exchange") == 2 and "isnull(ein" in joined
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_flipped_vote_moves_only_its_name(spark):
    more = [(20, "twice", "200000002"), (21, "solo", "770000001"), (22, "new", None)]
    old, new = id_map(spark), id_map(spark, ROWS + more)
    changes = identity.map_changes(old, new)
    assert {tuple(r) for r in changes.collect()} == {
        ("twice", "200000001", "200000002"), ("solo", None, "770000001")}
    moved = {r["id"]: (r["old_key"], r["key"]) for r in identity.rekeyed(filings(spark), changes).collect()}
    before, after = keys(identity.resolve(filings(spark), old)), keys(identity.resolve(filings(spark), new))
    assert moved == {k: (before[k], after[k]) for k in before if before[k] != after[k]} and set(moved) == {4, 6}
    # sums kept by key follow by what moved alone
    count = lambda df, key, sign: df.select(F.col(key).alias("key"), F.lit(sign).alias("n"))
    rows = identity.rekeyed(filings(spark), changes)
    sums = count(identity.resolve(filings(spark), old), "key", 1).union(count(rows, "old_key", -1)).union(count(rows, "key", 1))
    got = {r["key"]: r["n"] for r in sums.groupBy("key").agg(F.sum("n").alias("n")).filter("n <> 0").collect()}
    want = {r["key"]: r["count"] for r in identity.resolve(filings(spark), new).groupBy("key").count().collect()}
    assert got == want


def test_no_change_moves_nothing(spark):
    changes = identity.map_changes(id_map(spark), id_map(spark))
    assert changes.count() == 0 and identity.rekeyed(filings(spark), changes).count() == 0
