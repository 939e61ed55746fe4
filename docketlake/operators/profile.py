"""One profile row per entity, from per-entity facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions.aggregates import counts_to_map, exact_mean
from docketlake.functions.normalize import WAGE_LEVELS, safe_ratio
from docketlake.operators.rollups import UNKNOWN_LEVEL
from docketlake.schema import RATIO

MAJORITY = "0.5"
TREND = (
    "filings", "new", "transfer", "continued", "certified", "denied", "withdrawn",
    "certified_withdrawn",
)
GC_SERIES = ("pwd", "perm", "pwd_approved", "perm_approved")


def _series(rows: Column, fields) -> Column:
    return F.transform(
        rows, lambda r: F.struct(r["year"].alias("year"), *[r[f].alias(f) for f in fields])
    )


def _map_by_code(rows: Column, value) -> Column:
    """code -> value(row); NULL when there is no coded row."""
    entries = F.transform(rows, lambda r: F.struct(r["code"].alias("k"), value(r).alias("v")))
    return F.when(F.size(rows) > 0, F.map_from_entries(entries))


def level_mix(totals: Column) -> Column:
    return counts_to_map(
        [(name, totals[f"level_{name}"]) for name in (*WAGE_LEVELS, UNKNOWN_LEVEL)]
    )


def code_year_map(by_code: Column) -> Column:
    """{code: {year: n}}"""
    return _map_by_code(
        by_code,
        lambda r: F.map_from_entries(
            F.transform(
                r["series"],
                lambda s: F.struct(s["year"].cast("string").alias("k"), s["filings"].alias("v")),
            )
        ),
    )


def evidence_flags(secondary: Column, dependent: Column, willful: Column, n: Column) -> Column:
    """Flags with the counts behind them: a majority for two, any for the third."""
    zero = F.lit(0).cast("long")
    n_total = F.coalesce(n, zero)

    def most(part: Column) -> Column:
        share = safe_ratio(part, n)
        return F.coalesce(share > F.lit(MAJORITY).cast("decimal(2,1)"), F.lit(False))

    share = F.round(F.coalesce(safe_ratio(secondary, n), F.lit(0).cast("decimal(1,0)")), 3)

    def counted(value: Column, part: Column) -> Column:
        return F.struct(
            value.alias("value"), F.coalesce(part, zero).alias("n_yes"), n_total.alias("n_total")
        )

    return F.struct(
        F.struct(
            most(secondary).alias("value"),
            F.lit("secondary_entity_share").alias("basis"),
            share.cast(RATIO).alias("share"),
            F.coalesce(secondary, zero).alias("n_secondary"),
            n_total.alias("n_total"),
        ).alias("staffing_shop"),
        counted(most(dependent), dependent).alias("h1b_dependent"),
        counted(F.coalesce(willful, zero) > 0, willful).alias("willful_violator"),
    )


def wage_ratio(totals: Column) -> Column:
    return exact_mean(totals["ratio_total"], totals["ratio_n"], 3).cast(RATIO)


def employer_profile(employers: DataFrame, lca: DataFrame, gc: DataFrame) -> DataFrame:
    """Employers joined to their LCA and green-card facets, missing sides kept."""
    sides = (
        employers.select("key")
        .join(lca.select("key", F.struct(*lca.columns).alias("l")), "key", "left")
        .join(gc.select("key", F.struct(*gc.columns).alias("g")), "key", "left")
    )
    lca_side, gc_side = F.col("l"), F.col("g")
    total, gc_total = lca_side["totals"], gc_side["totals"]

    def count(side: Column, field: str) -> Column:
        return F.coalesce(side[field], F.lit(0)).cast("long")

    n_pwd, n_perm = count(gc_total, "pwd"), count(gc_total, "perm")
    return sides.select(
        "key",
        F.least(lca_side["first_year"], gc_side["first_year"]).alias("first_year"),
        F.greatest(lca_side["last_year"], gc_side["last_year"]).alias("last_year"),
        count(total, "filings").alias("n_lca"),
        count(total, "certified").alias("n_certified"),
        count(total, "certified_withdrawn").alias("n_certified_withdrawn"),
        count(total, "denied").alias("n_denied"),
        count(total, "withdrawn").alias("n_withdrawn"),
        count(total, "new").alias("n_new"),
        count(total, "transfer").alias("n_transfer"),
        count(total, "continued").alias("n_continued"),
        n_pwd.alias("n_pwd"),
        n_perm.alias("n_perm"),
        ((n_pwd + n_perm) > 0).alias("does_gc"),
        wage_ratio(total).alias("wage_vs_pw"),
        _series(gc_side["by_year"], GC_SERIES).alias("gc_by_year"),
        _map_by_code(gc_side["by_code"], lambda r: r["totals"]).alias("gc_by_soc"),
        code_year_map(lca_side["by_code"]).alias("filings_by_soc_year"),
        _series(lca_side["by_year"], TREND).alias("trend"),
        level_mix(total).alias("level_mix"),
        evidence_flags(
            total["secondary"], total["dependent"], total["willful"], total["filings"]
        ).alias("red_flags"),
    )
