"""A name that holds most filings: the map join splits it, results stay whole."""

from pyspark.sql import functions as F

from docketlake.operators import identity
from docketlake.session import materialize

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
}


def test_dominating_name_is_split(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        n = 60_000
        filings = spark.range(0, n, 1, 8).select(
            F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id") % 500)).alias("nm"),
            F.lit(None).cast("string").alias("ein"),
            F.sha2(F.col("id").cast("string"), 256).alias("rest"),
        )
        votes = spark.createDataFrame(
            [("hot", "941156497", 2), ("hot", "130000001", 1), ("n3", "200000001", 1)],
            "nm string, ein string, n long")
        id_map = materialize(identity.name_id_map(votes), "map")
        keyed = identity.resolve(filings, id_map)
        got = {r["key"]: r["count"] for r in keyed.groupBy("key").count().collect()}
        assert got["941156497"] == n - n // 3 and sum(got.values()) == n
        assert got["200000001"] == n // 3 // 500
        keyed.collect()
        plan = keyed._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
