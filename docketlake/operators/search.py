"""Tiered prefix index: short prefixes always, deeper ones only under overflow."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions import normalize as nz
from docketlake.functions.aggregates import ordered_array

Cut = Callable[[DataFrame, str], DataFrame]

CAP = 50
BASE_DEPTH = 3


def prefix_index(
    entries: DataFrame,
    name: str,
    order: Sequence[Column],
    payload: Sequence[str],
    cap: int = CAP,
    max_depth: int = nz.MAX_DEPTH,
    cut: Cut | None = None,
) -> DataFrame:
    """(prefix, total, rank, payload): the ranked head of every live bucket.

    ``name`` holds once-cleaned names. Depth two and three use the name cleaned
    again (a dropped character may leave a leading or double space), deeper
    prefixes cut the once-cleaned name. A bucket at depth d+1 exists where its
    parent at depth d >= 3 holds more than ``cap`` members.

    Membership needs no level-by-level loop. A member descends if its own
    three-character bucket overflows (at most 37^3 such buckets, so that set is
    always small enough to broadcast); below, the counts of ever longer prefixes
    only fall, so a deeper bucket exists exactly if its direct parent overflows.

    Ranking keeps the first ``cap`` rows per prefix on the map side already, so
    a prefix shared by most names moves ``cap`` rows per task, not all of them.
    Members named exactly like the bucket come first: they cannot descend.
    ``total`` is the true member count.

    ``cut`` (``session.materialize``) stores the entries and their memberships
    once; without it each of the reads below derives the entries again.
    """
    keep = cut or (lambda df, _: df)
    named = keep(entries.withColumn("_base", nz.base_prefixes(F.col(name))), "search-entries")
    base = named.withColumn("prefix", F.explode("_base"))

    top = F.get("_base", F.lit(1))
    crowded = (
        named.groupBy(top.alias("_top")).agg(F.count("*").alias("_n"))
        .filter(F.col("_top").isNotNull() & (F.col("_n") > cap)).select("_top")
    )
    depths = F.sequence(F.lit(BASE_DEPTH + 1), F.least(F.length(name), F.lit(max_depth)))
    deep = (
        named.filter(F.length(name) > BASE_DEPTH)
        .withColumn("_top", top)
        .join(F.broadcast(crowded), "_top", "left_semi")
        .withColumn("prefix", F.explode(F.transform(depths, lambda d: F.substr(name, F.lit(1), d))))
        .drop("_top")
    )
    every = base.unionByName(deep) if max_depth > BASE_DEPTH else base
    members = keep(every.drop("_base"), "search-members")

    counts = members.groupBy("prefix").agg(F.count("*").alias("total"))
    parents = counts.filter(F.col("total") > cap).select(F.col("prefix").alias("_parent"))
    shallow = F.length("prefix") <= BASE_DEPTH + 1
    # A shallow bucket needs no parent: it looks itself up under a key that
    # never matches, so one join serves all depths.
    parent = F.when(~shallow, F.expr("substring(prefix, 1, length(prefix) - 1)"))
    live = (
        counts.withColumn("_up", parent)
        .join(parents, F.col("_up") == F.col("_parent"), "left")
        .filter(shallow | F.col("_parent").isNotNull())
        .select("prefix", "total")
    )

    exact = (F.col(name) == F.col("prefix")).cast("int")
    first = Window.partitionBy("prefix").orderBy(exact.desc(), *order)
    heads = members.withColumn("_seat", F.row_number().over(first)).filter(F.col("_seat") <= cap)
    ranked = heads.join(live, "prefix").withColumn(
        "rank", F.row_number().over(Window.partitionBy("prefix").orderBy(*order))
    )
    return ranked.select("prefix", "total", "rank", *payload)


def index_documents(heads: DataFrame, root: str, results: Sequence[Column]) -> DataFrame:
    """(family, key, body) with ``{prefix, total, results}``, at most the cap long."""
    grouped = heads.groupBy("prefix", "total").agg(
        ordered_array(F.col("rank"), F.struct(*results).alias("hit")).alias("_ranked")
    )
    hits = F.transform("_ranked", lambda r: r["hit"])
    body = F.struct("prefix", "total", hits.alias("results"))
    return grouped.select(
        F.lit(root).alias("family"),
        F.concat(F.lit(f"{root}/"), F.col("prefix"), F.lit(".json")).alias("key"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("body"),
    )


# --- the two indexes of the store --------------------------------------------


def employer_entries(employers: DataFrame, profile: DataFrame) -> DataFrame:
    """Employers by cleaned name; those without wage filings count zero."""
    return employers.join(profile.select("key", "n_lca"), "key").select(
        nz.search_norm(F.col("name")).alias("nm"), "key", "ein", "name",
        F.col("n_lca").alias("n_filings"),
    )


def employer_index(entries: DataFrame, cap: int = CAP, cut: Cut | None = None) -> DataFrame:
    order = [F.col("n_filings").desc(), F.col("name"), F.col("key")]
    payload = ["key", "ein", "name", "n_filings"]
    return prefix_index(entries, "nm", order, payload, cap, cut=cut)


def title_corpus(job_titles: DataFrame) -> DataFrame:
    """Titles across entities by (cleaned title, code); shown as first met in
    (key, largest count, code, title) order."""
    # A title is cleaned once, not once for every entity that files it.
    first = F.min(F.struct("key", (-F.col("n_filings")).alias("most"))).alias("_first")
    titles = job_titles.groupBy("title", "soc_code").agg(first, F.sum("n_filings").alias("n"))
    met = F.struct("_first", "soc_code", "title")
    return (
        titles.withColumn("nm", nz.search_norm(F.col("title")))
        .groupBy("nm", "soc_code")
        .agg(F.min_by("title", met).alias("title"), F.sum("n").alias("n"))
    )


def title_index(corpus: DataFrame, cap: int = CAP, cut: Cut | None = None) -> DataFrame:
    order = [F.col("n").desc(), F.col("soc_code"), F.col("title")]
    return prefix_index(corpus, "nm", order, ["title", "soc_code", "n"], cap, cut=cut)


def reachability(heads: DataFrame, entries: DataFrame, key: str = "key") -> DataFrame:
    """(n_entries, n_reachable, share): entries in the head of some live bucket."""
    reached = heads.select(key).distinct().withColumn("_hit", F.lit(True))
    return entries.select(key).join(reached, key, "left").agg(
        F.count("*").alias("n_entries"), F.count("_hit").alias("n_reachable")
    ).withColumn(
        "share", F.round(nz.safe_ratio(F.col("n_reachable"), F.col("n_entries")), 3)
        .cast("decimal(6,3)"),
    )
