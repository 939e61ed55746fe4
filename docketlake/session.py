"""Session defaults, and cutting lineage through a shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this package relies on. The ANSI mode, the UTC zone and
#: the adaptive rules change results or plans; memory and cores are the caller's.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One hash table per reducer instead of two sorts when the measured build
    # side is small enough in every partition.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # The JVM never compiles a method above 8,000 bytes of code: a stage with many wide
    # expressions would be interpreted row by row. Above it Spark generates smaller methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Where rows already lie in the order of their groups, one pass over them replaces a partial and
    # a final hash table; lists per group (collect_list) would else be sorted twice.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
}


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    find_package(spark)
    return spark


def find_package(spark: SparkSession) -> None:
    """Let Python workers on machines that have this package's folder import it."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [known, home]))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables, ``spark.checkpoint.dir``.

    Without one a session in a single process (``local[n]``, as in tests) takes a
    temporary folder, and any other is an error: its machines share no such folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    folder = tempfile.mkdtemp(prefix="docketlake-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Paths written within each open ``intermediates`` block, the innermost last.
_written: list[list[str]] = []


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Remove what ``materialize`` writes within the block when the block ends.

    What should outlast it, such as serving tables, must be written within it: frames
    that read the intermediate tables cannot be evaluated afterwards.
    """
    _written.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in map(hadoop.Path, _written.pop()):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Whether a job's shuffle files go when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes within the block leave no shuffle files behind, so that the disk holds those of one job.

    Only for jobs that run once, as a write does: a plan that runs again would compute its shuffles anew.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back. Within ``intermediates`` the table goes when that ends.

    Several consumers then share one computation, later column pruning and
    filters still reach the parquet scan, and a lost executor costs a re-read
    rather than a recomputation. The job's shuffle files go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
