"""Exact continuous percentiles per group, without a large group in one task.

Rows are first counted per (group, value). A value belongs to a coarse bucket that
is monotone in the value; the bucket counts, a short list, tell which bucket holds
each wanted rank, and only those buckets are ordered, each on its own. Groups of
every size go the same way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.operators.joins import join_null_safe


def coarse_bucket(value: Column, steps: int = 64) -> Column:
    """Signed logarithmic bucket, non-decreasing in ``value``.

    Any decimal fits in a few thousand buckets, and one bucket spans about
    1/steps of its value.
    """
    v = value.cast("double")
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * steps)).cast("int")


def value_counts(
    rows: DataFrame, group: Sequence[str], value: str, *extra: Column
) -> DataFrame:
    """(group, value, n, extra): the histogram the percentiles read."""
    return rows.groupBy(*group, value).agg(F.count("*").alias("n"), *extra)


def _running(*partition: str, order: str):
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )


def _spots(n: Column, probs: Mapping[str, str]) -> dict[str, Column]:
    """0-based fractional rank of each percentile among ``n`` rows."""
    last = (n - 1).cast("decimal(20,0)")
    return {name: last * F.lit(p).cast("decimal(10,6)") for name, p in probs.items()}


def _interpolated(
    spots: Mapping[str, Column], value: Column, start: Column, end: Column, scale: int
) -> list[Column]:
    """Percentiles from rows that cover ranks ``start`` to ``end`` - 1, as decimals."""
    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= start) & (rank < end), value))

    out = []
    for name, spot in spots.items():
        low, high = at(F.floor(spot).cast("long")), at(F.ceil(spot).cast("long"))
        share = F.max((spot - F.floor(spot)).cast("decimal(7,6)"))
        out.append(F.round(low + (high - low) * share, scale).alias(name))
    return out


def grouped_percentiles(
    hist: DataFrame,
    group: Sequence[str],
    value: str,
    probs: Mapping[str, str],
    scale: int = 2,
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Percentiles of a histogram (group, value, n) with linear interpolation.

    ``probs`` maps output names to decimal literals ("0.25"), ``extra`` output
    names to aggregates over histogram rows. Adds ``n``, the rows per group. The
    histogram is read three times and should be stored.
    """
    group, extra, c = list(group), dict(extra or {}), F.col
    extras = [e.alias(name) for name, e in extra.items()]
    placed = hist.withColumn("_bucket", coarse_bucket(c(value)))
    totals = hist.groupBy(*group).agg(F.sum("n").alias("_n"), *extras)
    buckets = placed.groupBy(*group, "_bucket").agg(F.sum("n").alias("_count"))
    upto = buckets.withColumn("_upto", F.sum("_count").over(_running(*group, order="_bucket")))
    ranks = F.array(*[
        f(s).cast("long") for s in _spots(c("_n"), probs).values() for f in (F.floor, F.ceil)
    ])
    below = c("_upto") - c("_count")
    wanted = join_null_safe(upto, totals, group).withColumn("_below", below).filter(
        F.exists(ranks, lambda r: (r >= below) & (r < c("_upto")))
    ).drop("_upto", "_count")
    values = placed.select(*group, "_bucket", value, c("n").alias("_c"))
    hit = join_null_safe(values, wanted, [*group, "_bucket"]).withColumn(
        "_end", c("_below") + F.sum("_c").over(_running(*group, "_bucket", order=value))
    )
    return hit.groupBy(*group, "_n", *extra).agg(
        *_interpolated(_spots(c("_n"), probs), c(value), c("_end") - c("_c"), c("_end"), scale)
    ).withColumnRenamed("_n", "n")
