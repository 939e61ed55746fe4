"""Serving tables rendered as JSON documents.

Every family is (family, key, piece, body, sha256, n_bytes). A document is one row, but for
very large ones of the streamed families (``plans.streamed``), whose last piece carries the
digest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.operators import search
from docketlake.operators.identity import union_all
from docketlake.plans.rebuild import ServingTables
from docketlake.plans.streamed import Section, json_text, streamed


def number(value: Column) -> Column:
    """Decimals are JSON numbers, never strings."""
    return value.cast("double")


# The JSON field names below are the contract of the documents.


def document(family: str, key: Column, body: Column) -> list[Column]:
    return [F.lit(family).alias("family"), key.alias("key"), json_text(body).alias("body")]


def seal(docs: DataFrame) -> DataFrame:
    """Documents of one row with the content digest and size that publishing compares.

    Documents that were sealed when they were made stay as they are.
    """
    if "sha256" in docs.columns:
        return docs
    return docs.select(
        "family", "key", F.lit(0).alias("piece"), "body", F.sha2("body", 256).alias("sha256"),
        F.octet_length("body").cast("long").alias("n_bytes"))


def digests(docs: DataFrame) -> DataFrame:
    """(key, sha256, n_bytes), one row a document."""
    return docs.filter(F.col("sha256").isNotNull()).select("key", "sha256", "n_bytes")


def _last(value: Column) -> list[Column]:
    """Sort fields that put NULL behind every value."""
    return [value.isNull(), value]


# --- families ----------------------------------------------------------------


def export_flags(employers: DataFrame, jobs: DataFrame, titles: DataFrame) -> DataFrame:
    """(key, has_jobs, has_titles)"""
    def present(facts: DataFrame, flag: str) -> DataFrame:
        return facts.select("key").distinct().withColumn(flag, F.lit(True))

    joined = (
        employers.select("key")
        .join(present(jobs, "_jobs"), "key", "left")
        .join(present(titles, "_titles"), "key", "left")
    )
    return joined.select(
        "key",
        F.col("_jobs").isNotNull().alias("has_jobs"),
        F.col("_titles").isNotNull().alias("has_titles"),
    )


def profile_documents(tables: ServingTables) -> DataFrame:
    c = F.col
    none, nothing = F.array(), F.create_map()
    flags = tables.employer_profile.withColumn(
        "red_flags",
        c("red_flags").withField("staffing_shop.share", number(c("red_flags.staffing_shop.share"))),
    )
    rows = (
        tables.employers.join(flags, "key")
        .join(export_flags(tables.employers, tables.jobs, tables.job_titles), "key")
    )
    body = F.struct(
        F.struct(c("key").alias("id"), "ein", "name").alias("employer"),
        F.struct(c("first_year").alias("first"), c("last_year").alias("last")).alias("years"),
        F.struct(
            c("n_lca").alias("lca"), c("n_certified").alias("certified"),
            c("n_certified_withdrawn").alias("certified_withdrawn"),
            c("n_denied").alias("denied"), c("n_withdrawn").alias("withdrawn"),
            c("n_new").alias("new"), c("n_transfer").alias("transfer"),
            c("n_continued").alias("continued"),
        ).alias("filings"),
        F.struct(
            F.when(c("does_gc"), "present").otherwise("absent").alias("evidence"),
            c("n_pwd").alias("pwd"), c("n_perm").alias("perm"),
            F.coalesce("gc_by_year", none).alias("by_year"),
            F.coalesce("gc_by_soc", nothing).alias("by_soc"),
        ).alias("green_card"),
        number(c("wage_vs_pw")).alias("wage_vs_prevailing"),
        "has_jobs", "has_titles",
        F.coalesce("filings_by_soc_year", nothing).alias("filings_by_soc_year"),
        F.coalesce("trend", none).alias("trend"),
        F.coalesce("level_mix", nothing).alias("level_mix"),
        "red_flags",
    )
    return rows.select(*document("profile", F.concat(F.lit("e/"), "key", F.lit(".json")), body))


def jobs_documents(jobs: DataFrame) -> DataFrame:
    c = F.col
    order = [-c("year"), c("soc_code"), *_last(c("level")), *_last(c("state")), *_last(c("county")), *_last(c("zip"))]
    row = F.struct(
        "year", "soc_code", "level", number(c("avg_wage")).alias("avg_offered_wage"),
        number(c("min_wage")).alias("min_wage"), number(c("max_wage")).alias("max_wage"),
        number(c("avg_prev_wage")).alias("avg_prevailing_wage"),
        "state", "county", "zip", "n_filings",
    )
    key = F.concat(F.lit("e/"), "key", F.lit("/jobs.json"))
    return streamed(jobs, "jobs", key, F.struct(c("key").alias("id")), [Section("jobs")], row, order)


def titles_documents(titles: DataFrame) -> DataFrame:
    c = F.col
    order = [-c("n_filings"), c("soc_code"), c("title")]
    row = F.struct(
        "soc_code", "title", "n_filings", number(c("avg_wage")).alias("avg_wage"),
        number(c("min_wage")).alias("min_wage"), number(c("max_wage")).alias("max_wage"),
        F.coalesce("level_mix", F.create_map()).alias("level_mix"),
    )
    key = F.concat(F.lit("e/"), "key", F.lit("/titles.json"))
    return streamed(titles, "titles", key, F.struct(c("key").alias("id")), [Section("titles")], row, order)


def wage_documents(benchmarks: DataFrame) -> DataFrame:
    c = F.col
    stat = F.struct(
        "year", "n_filings", "employer_count",
        *[number(c(p)).alias(p) for p in ("p25", "p50", "p75", "mean", "min_wage", "max_wage")],
    )
    sections = [Section("national"), Section("states", by_place=True), Section("zips", by_place=True)]
    section = F.when(c("scope") == "national", 0).when(c("scope") == "state", 1).otherwise(2)
    place = F.when(c("scope") == "zip", c("zip")).when(c("scope") == "state", c("state"))
    key = F.concat(F.lit("w/"), "soc_code", F.lit("/"), F.coalesce("level", F.lit("NA")), F.lit(".json"))
    order = [*_last(c("state")), *_last(c("zip")), c("year")]
    return streamed(
        benchmarks, "wages", key, F.struct("soc_code", "level"), sections, stat, order, section, place)


def employer_search_documents(heads: DataFrame) -> DataFrame:
    c = F.col
    return search.index_documents(
        heads, "s", [c("key").alias("id"), c("ein"), c("name"), c("n_filings")]
    )


def title_search_documents(heads: DataFrame) -> DataFrame:
    return search.index_documents(heads, "t", [F.col("title"), F.col("soc_code"), F.col("n")])


META_TABLES = ("employers", "jobs", "gc_filings", "job_titles", "wage_benchmarks")


def table_counts(tables: ServingTables) -> DataFrame:
    """(table, n) of the tables the meta document reports."""
    counted = [
        getattr(tables, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n")
        for t in META_TABLES
    ]
    return union_all(*counted)


def meta_document(counts: DataFrame, manifest: DataFrame, built_at: str) -> DataFrame:
    """The meta document: row counts, build time, objects served (itself included)."""
    served = manifest.agg((F.count("*") + 1).alias("n")).select(
        F.lit(None).cast("string").alias("table"), "n"
    )
    is_table = F.col("table").isNotNull()
    pair = F.struct(F.col("table").alias("k"), F.col("n").alias("v"))
    joined = counts.unionByName(served).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(is_table, pair)))).alias("rows"),
        F.max(F.when(~is_table, F.col("n"))).alias("objects"),
    )
    body = F.struct(
        F.lit(True).alias("ok"), "rows", F.lit(built_at).alias("built_at"), "objects"
    )
    return joined.select(*document("meta", F.lit("meta.json"), body))


def families(
    tables: ServingTables, cap: int = search.CAP, cut: search.Cut | None = None,
) -> tuple[DataFrame, ...]:
    """(family, key, piece, body, sha256, n_bytes), a frame for each family but meta.

    ``tables`` should be stored ones: several families read the same table.
    """
    entries = search.employer_entries(tables.employers, tables.employer_profile)
    corpus = search.title_corpus(tables.job_titles)
    made = (
        profile_documents(tables),
        jobs_documents(tables.jobs),
        titles_documents(tables.job_titles),
        wage_documents(tables.wage_benchmarks),
        employer_search_documents(search.employer_index(entries, cap, cut)),
        title_search_documents(search.title_index(corpus, cap, cut)),
    )
    return tuple(map(seal, made))


def all_documents(
    tables: ServingTables, cap: int = search.CAP, cut: search.Cut | None = None,
) -> DataFrame:
    """(family, key, piece, body, sha256, n_bytes) of every family but meta, in one frame."""
    return union_all(*families(tables, cap, cut))
