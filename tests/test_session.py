"""Intermediate tables: kept by default, removed with their block."""

import os
import time
from urllib.parse import urlparse

import pytest

from docketlake.session import intermediates, materialize


def folders(df):
    return {os.path.dirname(urlparse(f).path) for f in df.inputFiles()}


def test_intermediate_tables_go_with_their_block(spark, tmp_path):
    kept = materialize(spark.range(5), "kept")
    with intermediates(spark):
        outer = folders(materialize(spark.range(3), "outer"))
        with intermediates(spark):
            inner = folders(materialize(spark.range(4), "inner"))
            materialize(spark.range(6), "also").write.parquet(str(tmp_path / "result"))
        assert not any(map(os.path.exists, inner)) and all(map(os.path.exists, outer))
    assert not any(map(os.path.exists, outer)) and all(map(os.path.exists, folders(kept)))
    assert kept.count() == 5 and spark.read.parquet(str(tmp_path / "result")).count() == 6


def test_tables_go_after_an_error_too(spark):
    with pytest.raises(RuntimeError), intermediates(spark):
        path = folders(materialize(spark.range(3), "lost"))
        raise RuntimeError("stop")
    assert not any(map(os.path.exists, path))


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.splitlines() if os.path.basename(f).startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    def gone(files):  # removed beside the job
        end = time.time() + 20
        while files & shuffle_files(spark) and time.time() < end:
            time.sleep(0.1)
        return not files & shuffle_files(spark)

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(name, None)
    rows = spark.range(5000).selectExpr("id % 100 AS k").repartition(3).groupBy("k").count()
    kept = materialize(rows, "grouped")
    assert gone(shuffle_files(spark) - before)
    assert spark.conf.get(name, None) == setting
    # Frames that were written can be written and read again, as can what reads the table.
    assert rows.count() == rows.count() == 100 and materialize(rows, "again").count() == kept.count() == 100
    joined = kept.join(rows, "k")
    assert joined.count() == 100 and len(joined.collect()) == len(joined.collect()) == 100
