"""Loading yearly disclosure files whose columns drift.

No record is lost without a word: what has too few or too many cells, or quotes that do
not close, is a rejected record with its file, the reason and its text, and counts in
``file_report`` and ``parse_gate``.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.operators.identity import union_all
from docketlake.operators.staging import RawFilings
from docketlake.schema import LAYOUTS, readable
from docketlake.sources.records import records, splits

#: Spellings of dates in spreadsheet exports; times of day are dropped.
DATE_FORMATS = (
    "yyyy-MM-dd", "M/d/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss",
    "d-MMM-yy", "d-MMM-yyyy",
)
FISCAL = "FY([0-9]{4})(?:_Q([1-4]))?"


def list_files(spark: SparkSession, folder: str, glob: str = "*.csv") -> list[str]:
    """File names under a folder (never their content)."""
    found = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").load(folder).select("path")
    )
    return sorted(r["path"] for r in found.collect())


def _typed(text: Column, dtype: str) -> Column:
    """A cell as its type; NULL where it does not parse, which ``unparsed`` counts."""
    value = F.nullif(F.trim(text), F.lit("")) if dtype != "string" else text
    if dtype == "date":
        parsed = [F.try_to_timestamp(value, F.lit(f)).cast("date") for f in DATE_FORMATS]
        return F.coalesce(*parsed)
    if dtype == "string":
        return value
    plain = F.regexp_replace(value, "[$,]", "")
    if dtype in ("int", "bigint", "smallint"):
        number = plain.try_cast("decimal(38,10)")  # spreadsheets write whole numbers as 1.0
        return F.when(number == F.floor(number), number.try_cast(dtype))
    return plain.try_cast(dtype)


Renames = Mapping[str, str]


def _columns(header: Iterable[str], source: str, renames: Renames | None) -> dict[str, str]:
    """Layout column to file column; a column the layout does not know is an error."""
    renames = {k.lower(): v for k, v in (renames or {}).items()}
    columns = {renames.get(c.strip().lower(), c.strip().lower()): c for c in header}
    unknown = sorted(set(columns) - set(LAYOUTS[source]))
    if unknown:
        raise ValueError(f"columns not in the {source} layout: {unknown}")
    return columns


#: The reader's own mark of a record that does not fit its header.
_MISFIT = "_misfit_record"
_QUOTED = '"(?:[^"]++|"")*+"'


@dataclass(frozen=True)
class Scan:
    """The records of files of one header: (file, record, reason, cells)."""

    rows: DataFrame
    columns: dict[str, str]

    def cell(self, column: str) -> Column:
        return F.col("cells").getField(self.columns[column])


def _reason(n_cells: int) -> Column:
    """Why a record does not fit a header of so many cells."""
    bare = F.regexp_replace("record", _QUOTED, "")
    found = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    counted = F.concat(found.cast("string"), F.lit(f" of {n_cells} cells"))
    return (F.when(F.contains(bare, F.lit('"')), F.lit("quotes do not match"))
            .when(found < n_cells, F.concat(F.lit("short record: "), counted))
            .when(found > n_cells, F.concat(F.lit("surplus cells: "), counted))
            .otherwise(F.lit("unreadable record")))


def _scans(spark: SparkSession, paths: Iterable[str], source: str, renames: Renames | None) -> Iterator[Scan]:
    """One scan per distinct header, with its columns."""
    known = splits(spark, paths)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path, line in sorted(known.headers.items()):
        header = tuple(next(csv.reader([line.removeprefix("\ufeff")]), ()))
        try:
            _columns(header, source, renames)
        except ValueError as error:
            raise ValueError(f"{path}: {error}") from None
        by_header.setdefault(header, []).append(path)
    for header, files in by_header.items():
        schema = ", ".join(f"`{c}` string" for c in [*header, _MISFIT])
        options = {"escape": '"', "columnNameOfCorruptRecord": _MISFIT, "maxColumns": "100000"}
        rows = records(spark, files, known).withColumn("cells", F.from_csv("record", F.lit(schema), options))
        misfit = F.col("cells").getField(_MISFIT).isNotNull()
        rows = rows.withColumn("reason", F.coalesce("reason", F.when(misfit, _reason(len(header)))))
        yield Scan(rows, _columns(header, source, renames))


@dataclass(frozen=True)
class Loaded:
    """Filings in the layout, and the records (file, reason, record) that could not be read."""

    rows: DataFrame
    rejects: DataFrame


def load(spark: SparkSession, paths: Iterable[str], source: str, renames: Renames | None = None) -> Loaded:
    """Delimited files mapped by column name onto the superset layout.

    Files of one header share a scan. Columns a file lacks are NULL; ``renames``
    maps columns the layout does not know, which are an error otherwise. Year and
    quarter come from the file name. Without files both frames are empty.
    """
    derived = {
        "source_fiscal_year": F.regexp_extract("file", FISCAL, 1),
        "source_quarter": F.regexp_extract("file", FISCAL, 2),
    }

    def column(scan: Scan, c: str, dtype: str) -> Column:
        if c in derived:
            return _typed(F.nullif(derived[c], F.lit("")), dtype)
        if c in scan.columns:
            return _typed(scan.cell(c), dtype)
        return F.lit(None).cast(dtype)

    scans = list(_scans(spark, paths, source, renames))
    if not scans:
        layout = ", ".join(f"{c} {t}" for c, t in LAYOUTS[source].items())
        return Loaded(spark.createDataFrame([], layout), spark.createDataFrame([], "file string, reason string, record string"))
    return Loaded(
        union_all(*[
            scan.rows.filter("reason IS NULL").select(*[column(scan, c, t).alias(c) for c, t in LAYOUTS[source].items()])
            for scan in scans]),
        union_all(*[scan.rows.filter("reason IS NOT NULL").select("file", "reason", "record") for scan in scans]))


def load_files(
    spark: SparkSession, paths: Iterable[str], source: str, renames: Renames | None = None
) -> DataFrame:
    """The filings of ``load``; what was rejected is in ``rejected`` and fails ``parse_gate``."""
    return load(spark, paths, source, renames).rows


def rejected(spark: SparkSession, paths: Iterable[str], source: str, renames: Renames | None = None) -> DataFrame:
    """The records (file, reason, record) that do not fit their file's header."""
    return load(spark, paths, source, renames).rejects


def load_file(spark: SparkSession, path: str, source: str, renames: Renames | None = None) -> DataFrame:
    return load_files(spark, [path], source, renames)


def load_folder(
    spark: SparkSession, folder: str, source: str, glob: str = "*.csv", renames: Renames | None = None
) -> DataFrame:
    return load_files(spark, list_files(spark, folder, glob), source, renames)


def file_report(
    spark: SparkSession, paths: Iterable[str], source: str, renames: Renames | None = None
) -> DataFrame:
    """(file, column, n_rows, n_unparsed, n_rejected) per file and typed column.

    ``n_unparsed`` counts cells that hold something the column's type does not
    read. ``n_rows`` and ``n_rejected`` are the file's records that were read and that
    were not, to be held against what was delivered.
    """
    reports = []
    for scan in _scans(spark, paths, source, renames):
        cells = F.array(*[
            F.struct(F.lit(c).alias("column"), (
                (F.coalesce(F.trim(scan.cell(c)), F.lit("")) != "") & _typed(scan.cell(c), t).isNull()).alias("bad"))
            for c, t in LAYOUTS[source].items() if c in scan.columns and t != "string"
        ] or [F.struct(F.lit("").alias("column"), F.lit(False).alias("bad"))])
        each = scan.rows.select("file", F.col("reason").isNull().alias("good"), F.inline(cells))
        reports.append(each.groupBy("file", "column").agg(
            F.count_if("good").alias("n_rows"), F.count_if(F.col("good") & F.col("bad")).alias("n_unparsed"),
            F.count_if(~F.col("good")).alias("n_rejected")))
    return union_all(*reports)


def parse_gate(report: DataFrame) -> DataFrame:
    """The gates (name, value, ok) that no present cell and no record was lost in loading."""
    per_file = report.groupBy("file").agg(F.sum("n_unparsed").alias("cells"), F.max("n_rejected").alias("records"))
    total = per_file.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cells", "records")])
    lost = F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).alias("value"))
                     for name, c in (("unparsed_cells", "cells"), ("rejected_records", "records"))])
    return total.select(F.inline(lost)).withColumn("ok", F.col("value") == 0)


def filings_from_tables(lca: DataFrame, pwd: DataFrame, perm: DataFrame) -> RawFilings:
    """Raw tables as the rebuild may see them: allow-listed columns only."""
    return RawFilings(readable(lca, "lca"), readable(pwd, "pwd"), readable(perm, "perm"))
