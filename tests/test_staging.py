"""Stored filings: what follows from other columns is not stored."""

from decimal import Decimal

from pyspark.sql import functions as F

from docketlake.functions import normalize as nz
from docketlake.operators import staging
from docketlake.session import materialize


def test_the_middle_of_a_range_is_derived(spark):
    """With open, hourly and unknown offers, as wide as the columns allow."""
    big = Decimal("99999999999999.9999")
    offers = [(Decimal("1.0001"), Decimal("2.0002"), "Year"), (Decimal("7.5"), None, "Year"), (None, Decimal(3), "Year"),
              (None, None, "Year"), (Decimal(5), Decimal(6), "Hour"), (Decimal(5), Decimal(6), None), (big, big, "Year"),
              (Decimal(-1), Decimal("0.0001"), "Year")]
    raw = spark.createDataFrame(offers, "lo decimal(18,4), hi decimal(18,4), unit string")
    low, top, mid = nz.wage_range(F.col("lo"), F.col("hi"), F.col("unit"))
    rows = raw.select(F.lit("a").alias("nm"), low.alias("wage_from"), mid.alias("wage_mid"), top.alias("wage_to"))
    written = []

    def keep(df, name):
        written.append(df.columns)
        return materialize(df, name)
    read = staging.without_middle(keep, rows, "filings")
    assert written == [["nm", "wage_from", "wage_to"]]
    assert read.dtypes == rows.dtypes and sorted(map(str, read.collect())) == sorted(map(str, rows.collect()))
    assert read.filter("wage_mid IS NULL").count() == 4
