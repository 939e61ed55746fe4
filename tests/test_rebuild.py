"""The rebuild writes what is read, once; an earlier state comes from the same filings."""

from pyspark.sql import functions as F

from docketlake.operators import staging
from docketlake.plans import documents
from docketlake.plans.rebuild import normalized, rebuild
from docketlake.session import materialize
from docketlake.sources.warehouse import filings

FOLDER = "/root/testdata/sf0.001"


def test_tables_are_written_when_they_are_read(spark):
    written = []

    def cut(df, name):
        written.append(name)
        return materialize(df, name)

    build = rebuild(filings(spark, FOLDER), cut=cut)
    assert written == []
    n = build.staging.gc.count()
    build.staging.gc.count()
    assert n and sorted(written) == ["certifications", "determinations", "filings", "gc", "name-id-map", "spellings"]
    stored = build.staging.lca
    assert written[-1] == "lca" and set(stored.columns).isdisjoint({"nm", "name", "d", "filed"})
    assert "wage-histogram" not in written and build.tables.wage_benchmarks.count()
    assert written.count("wage-histogram") == 1 and written.count("filings") == 1


def test_keyed_filings_are_not_written_again(spark):
    rows = {}

    def cut(df, name):
        kept = materialize(df, name)
        rows[name] = kept
        return kept

    build = rebuild(filings(spark, FOLDER), cut=cut)
    whole = build.staging.lca.count()
    own = build.normalized.lca.filter("nm IS NOT NULL AND d IS NOT NULL AND ein IS NOT NULL").count()
    assert 0 < own < whole and rows["lca"].count() == whole - own


def test_an_earlier_state_is_part_of_the_same_filings(spark):
    date = "2001-01-01"
    now = normalized(filings(spark, FOLDER), materialize)
    for got, want in zip(staging.filed_before(now, date).all(), staging.normalize(filings(spark, FOLDER, date)).all()):
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()


def test_rows_move_before_they_are_text(spark):
    rows = spark.createDataFrame(
        [("a", "15-1252", "x", 2), ("a", "15-1252", "y", 3)], "key string, soc_code string, title string, n_filings long")
    none = F.lit(None).cast("double")
    titles = rows.select("*", *[none.alias(n) for n in ("avg_wage", "min_wage", "max_wage")],
                         F.lit(None).cast("map<string,bigint>").alias("level_mix"))
    docs = documents.titles_documents(titles)
    node, moved = docs._jdf.queryExecution().optimizedPlan(), None
    while moved is None:  # down to what the exchange moves
        if node.nodeName() == "RepartitionByExpression":
            moved = node.output().mkString(" ")
        node = node.children().head()
    assert "title" in moved and "text" not in moved and "head" not in moved
    assert docs.count() == 1
