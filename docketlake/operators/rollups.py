"""Staging rows to the aggregated serving tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from docketlake.functions.aggregates import (
    count_where,
    counts_to_map,
    exact_mean,
    label_counts,
    ordered_array,
)
from docketlake.functions.normalize import WAGE_LEVELS
from docketlake.operators.joins import join_null_safe
from docketlake.operators.percentiles import grouped_percentiles, value_counts
from docketlake.schema import WAGE

UNKNOWN_LEVEL = "unknown"
MIN_CELL = 5

# The four outcomes of a filing and the two green-card sources.
STATUSES = {
    "certified": "Certified",
    "certified_withdrawn": "Certified - Withdrawn",
    "denied": "Denied",
    "withdrawn": "Withdrawn",
}
GC_TYPES = ("PWD", "PERM")
# End of fixed values.


def coded_annual(lca: DataFrame) -> DataFrame:
    """Filings the wage tables count: coded and quoted per year."""
    return lca.filter(F.col("soc").isNotNull() & F.col("wage_mid").isNotNull())


def jobs(lca: DataFrame) -> DataFrame:
    """Wages per entity, year, code, level and place; NULL is a group of its own."""
    grain = ["key", "year", "soc", "level", "state", "county", "zip"]
    return (
        coded_annual(lca)
        .groupBy(*grain)
        .agg(
            exact_mean(F.sum("wage_mid"), F.count("wage_mid"), 2).cast(WAGE).alias("avg_wage"),
            F.min("wage_from").cast(WAGE).alias("min_wage"),
            F.max("wage_to").cast(WAGE).alias("max_wage"),
            exact_mean(F.sum("pw"), F.count("pw"), 2).cast(WAGE).alias("avg_prev_wage"),
            F.count("*").alias("n_filings"),
        )
        .withColumnRenamed("soc", "soc_code")
    )


def gc_filings(gc_coded: DataFrame) -> DataFrame:
    return (
        gc_coded.groupBy("key", "year", F.col("typ").alias("type"), F.col("soc").alias("soc_code"))
        .agg(
            F.count("*").alias("n"),
            count_where(F.col("approved")).alias("n_approved"),
        )
    )


def job_titles(lca: DataFrame) -> DataFrame:
    """Counts over every filing of a title, wages over the annual ones.

    The count-weighted mean of the per-level means is the plain mean, and the
    levels are a closed domain, so one aggregation yields the whole row.
    """
    levels = label_counts(F.col("level"), WAGE_LEVELS, UNKNOWN_LEVEL)
    counted = (
        lca.filter(F.col("soc").isNotNull() & F.col("title").isNotNull())
        .groupBy("key", F.col("soc").alias("soc_code"), "title")
        .agg(
            F.count("*").alias("n_filings"),
            exact_mean(F.sum("wage_mid"), F.count("wage_mid"), 2).cast(WAGE).alias("avg_wage"),
            F.min("wage_from").cast(WAGE).alias("min_wage"),
            F.max("wage_to").cast(WAGE).alias("max_wage"),
            *[n.alias(f"_level_{name}") for name, n in levels],
        )
    )
    mix = counts_to_map([(name, F.col(f"_level_{name}")) for name, _ in levels])
    return counted.select(
        "key", "soc_code", "title", "n_filings", "avg_wage", "min_wage", "max_wage",
        mix.alias("level_mix"),
    )


# --- wage benchmarks ---------------------------------------------------------


def _scope(fixed: Sequence[str], tiers: Sequence[str], *tail: str) -> list[list]:
    """Grouping sets from coarse to fine: fixed, fixed+tier 1, fixed+tiers 1-2, ..."""
    return [[*fixed, *tiers[:i], *tail] for i in range(len(tiers) + 1)]


def _tiered(
    rows: DataFrame, fixed: Sequence[str], tiers: Sequence[str], tail: Sequence[str], aggs
) -> DataFrame:
    """Aggregate over every tier at once; ``depth`` tells how many tiers a row has."""
    sets = [[F.col(c) for c in s] for s in _scope(fixed, tiers, *tail)]
    depth = sum((1 - F.grouping(t)).cast("int") for t in tiers)
    return rows.groupingSets(sets, *fixed, *tiers, *tail).agg(*aggs, depth.alias("depth"))


def tiered_benchmarks(
    rows: DataFrame,
    fixed: Sequence[str],
    tiers: Sequence[str],
    value: str,
    low: str,
    high: str,
    entity: str,
    min_cell: int = MIN_CELL,
    cut: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Counts, distinct entities, exact percentiles, mean, min and max per tier.

    ``tiers`` run from coarse to fine. A tier NULL that is in the data is told
    from a rolled-up one by ``depth``; rows whose own tier is NULL drop, and the
    finest tier keeps cells of at least ``min_cell`` rows.

    Percentiles and distinct counts take separate ways: a histogram, and the places of
    each entity (``tiered_entities``). Both reduce at the finest grain before the tiers
    multiply rows. ``cut`` (e.g. ``materialize``) lets the two reads of the histogram
    share one computation.
    """
    fixed, tiers = list(fixed), list(tiers)
    fine = value_counts(
        rows, [*fixed, *tiers], value, F.min(low).alias("_low"), F.max(high).alias("_high")
    )
    hist = _tiered(
        fine, fixed, tiers, [value],
        [F.sum("n").alias("n"), F.min("_low").alias("_low"), F.max("_high").alias("_high")],
    )
    if cut:
        hist = cut(hist, "wage-histogram")

    def own_tier_known(depth: Column) -> Column:
        known = F.lit(True)
        for i, tier in enumerate(tiers, start=1):
            known = F.when(depth == i, F.col(tier).isNotNull()).otherwise(known)
        return known

    finest = len(tiers)
    keep = own_tier_known(F.col("depth")) & (
        (F.col("depth") < finest) | (F.col("n") >= min_cell)
    )
    stats = grouped_percentiles(
        hist,
        [*fixed, *tiers, "depth"],
        value,
        {"p25": "0.25", "p50": "0.50", "p75": "0.75"},
        extra={
            "_total": F.sum((F.col(value) * F.col("n").cast("decimal(18,0)")).cast("decimal(38,5)")),
            "min_wage": F.min("_low"),
            "max_wage": F.max("_high"),
        },
    ).filter(keep)

    entities = tiered_entities(rows, fixed, tiers, entity, "employer_count")
    keys = [*fixed, *tiers, "depth"]
    return join_null_safe(stats, entities, keys).select(
        *keys,
        F.col("n").alias("n_filings"),
        "employer_count",
        *[F.col(p).cast(WAGE).alias(p) for p in ("p25", "p50", "p75")],
        exact_mean(F.col("_total"), F.col("n"), 2).cast(WAGE).alias("mean"),
        F.col("min_wage").cast(WAGE).alias("min_wage"),
        F.col("max_wage").cast(WAGE).alias("max_wage"),
    )


def tiered_entities(
    rows: DataFrame, fixed: Sequence[str], tiers: Sequence[str], entity: str, name: str
) -> DataFrame:
    """(fixed, tiers, depth, name): how many entities each cell of each tier has, exactly.

    Entities are moved once, by (fixed, entity), with the distinct places of each. All its
    cells then lie in one row, so every tier deduplicates there, and only cells and
    counts are moved on. A list is as long as the places one entity files from in one
    fixed cell. (A bitmap a cell would hold 4 KB for each of its blocks of entities, while
    most cells have a handful of them.)
    """
    fixed, tiers = list(fixed), list(tiers)
    placed = rows.groupBy(*fixed, entity).agg(
        F.collect_set(F.struct(*tiers)).alias("_places"))

    def tier(depth: int) -> Column:
        """The distinct cells of one tier among an entity's places; deeper tiers are NULL."""
        def cut(place: Column) -> Column:
            known = [place[t] for t in tiers[:depth]]
            deeper = [F.lit(None).cast(rows.schema[t].dataType) for t in tiers[depth:]]
            return F.struct(F.lit(depth).alias("depth"), *[c.alias(t) for c, t in zip([*known, *deeper], tiers)])
        return F.array_distinct(F.transform("_places", cut))

    cells = F.flatten(F.array(*[tier(d) for d in range(len(tiers) + 1)]))
    return placed.select(*fixed, entity, F.inline(cells)).groupBy(*fixed, *tiers, "depth").agg(F.count(entity).alias(name))


def wage_benchmarks(
    lca: DataFrame, min_cell: int = MIN_CELL, cut: Callable | None = None
) -> DataFrame:
    cells = tiered_benchmarks(
        coded_annual(lca), ["soc", "level", "year"], ["state", "zip"],
        "wage_mid", "wage_from", "wage_to", "key", min_cell, cut,
    )
    scope = F.element_at(F.array(*map(F.lit, ("national", "state", "zip"))), F.col("depth") + 1)
    return cells.withColumn("scope", scope).withColumnRenamed("soc", "soc_code").drop("depth")


# --- per-entity facets -------------------------------------------------------


def lca_cells(lca: DataFrame) -> DataFrame:
    """Every per-entity count, at (key, soc, year).

    All profile figures are sums of these cells, so filings are read and
    shuffled once, map-side combined.
    """
    ratio = (F.col("wage_mid") / F.nullif(F.col("pw"), F.lit(0).cast("decimal(18,4)"))).cast(
        "decimal(38,16)"
    )
    ratio = F.when(F.col("pw") > 0, ratio)
    measures = {
        "filings": F.count("*"),
        **{name: count_where(F.col("status") == s) for name, s in STATUSES.items()},
        "new": F.sum(F.col("new_emp").cast("long")),
        "transfer": F.sum(F.col("chg_emp").cast("long")),
        "continued": F.sum(F.col("cont_emp").cast("long")),
        "secondary": count_where(F.col("secondary")),
        "dependent": count_where(F.col("dependent")),
        "willful": count_where(F.col("willful")),
        "ratio_total": F.sum(ratio),
        "ratio_n": F.count(ratio),
        **{
            f"level_{name}": n
            for name, n in label_counts(F.col("level"), WAGE_LEVELS, UNKNOWN_LEVEL)
        },
    }
    return lca.groupBy("key", "soc", "year").agg(*[m.alias(k) for k, m in measures.items()])


def gc_cells(gc: DataFrame) -> DataFrame:
    """Green-card counts at (key, soc, year), uncoded filings included."""
    measures = {}
    for typ in GC_TYPES:
        of_type = F.col("typ") == typ
        measures[typ.lower()] = count_where(of_type)
        measures[f"{typ.lower()}_approved"] = count_where(of_type & F.col("approved"))
    return gc.groupBy("key", "soc", "year").agg(*[m.alias(k) for k, m in measures.items()])


def entity_facets(
    cells: DataFrame,
    key: str,
    code: str,
    year: str,
    by_code: Mapping[str, Sequence[str]],
) -> DataFrame:
    """Cells to one row per entity: totals, a series by year, maps by code.

    Output: ``key``, ``first_year``, ``last_year``, ``totals`` (struct of all
    measures), ``by_year`` (array ordered by year), and ``by_code`` (array
    ordered by code of code, ``series`` by year and ``totals`` over the measures
    named in ``by_code``; NULL codes excluded).

    After one move to a partitioning by entity, the two aggregations below and
    the profile joins need no further shuffle. What moves is cells, already
    spread by (key, code, year), never filings. One sort by (entity, year) lets both
    aggregations run over their groups in order (``session.DEFAULTS``), each cell once. Of a
    code only the measures named go along, as an entity's list of cells; ``_runs`` cuts it.
    """
    c = F.col
    measures = [m for m in cells.columns if m not in (key, code, year)]
    kept = list(by_code["measures"])
    home = cells.repartition(key).sortWithinPartitions(key, year)
    coded = F.when(c(code).isNotNull(), F.struct(c(code).alias("code"), c(year).alias("year"), *kept))
    per_year = home.groupBy(key, year).agg(
        *[F.sum(m).alias(m) for m in measures], F.collect_list(coded).alias("_coded")
    ).sortWithinPartitions(key, year)
    whole = per_year.groupBy(key).agg(
        F.struct(*[F.sum(m).alias(m) for m in measures]).alias("totals"),
        ordered_array(c(year).alias("year"), *measures).alias("by_year"),
        F.sort_array(F.flatten(F.collect_list("_coded"))).alias("_cells"),
    )

    def of_code(run: Column) -> Column:
        series = F.transform(run, lambda x: F.struct(x["year"], *[x[m].alias(m) for m in kept]))
        return F.struct(
            run[0]["code"].alias("code"), series.alias("series"),
            F.struct(*[_total(run, m, cells.schema[m].dataType).alias(m) for m in kept]).alias("totals"),
        )
    return _runs(whole, "_cells", "code").select(
        key,
        c("by_year")[0]["year"].alias("first_year"),
        F.element_at("by_year", -1)["year"].alias("last_year"),
        "totals", "by_year", F.transform("_runs", of_code).alias("by_code"),
    )


def _runs(rows: DataFrame, ordered: str, field: str) -> DataFrame:
    """Add ``_runs``: an ordered array of structs cut where a field changes, linear in its length."""
    def starts(x: Column, i: Column) -> Column:
        return F.when(~x[field].eqNullSafe(F.get(ordered, i - 1)[field]), i)

    def run(start: Column, j: Column) -> Column:
        end = F.coalesce(F.get("_starts", j + 1), F.size(ordered))
        return F.slice(ordered, start + 1, end - start)
    marked = rows.withColumn("_starts", F.array_compact(F.transform(ordered, starts)))
    return marked.withColumn("_runs", F.transform("_starts", run))


def _total(run: Column, measure: str, kind: DataType) -> Column:
    """The sum of a field over an array, NULL passed over."""
    return F.aggregate(
        run, F.lit(None).cast(kind), lambda total, x: F.coalesce(total + x[measure], total, x[measure]).cast(kind))


def lca_facets(lca: DataFrame) -> DataFrame:
    return entity_facets(lca_cells(lca), "key", "soc", "year", {"measures": ["filings"]})


def gc_facets(gc: DataFrame) -> DataFrame:
    return entity_facets(gc_cells(gc), "key", "soc", "year", {"measures": ["pwd", "perm"]})
