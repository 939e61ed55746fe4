"""Records of delimited files, whole where a quoted cell holds line feeds.

A line begins a record exactly if an even number of quotes stands before it in its
file. Files stay splittable: each split is read by its own task, which counts the
quotes of its lines; the few splits that begin within quotes are known from the sums
of those before them, and only the lines of records over several lines are moved.
The driver holds one row per file and the splits that begin within quotes.

A quote that is never closed would make one record of all the rest. A record above
``MOST_LINES`` lines is therefore given back line by line, as lines that cannot be read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketlake.session import find_package, materialize

#: Lines that one record may have.
MOST_LINES = 10_000
#: Why a line is not part of a record.
UNCLOSED = "quote not closed"

LINES = "file string, split long, text string"
SPLITS = "file string, split long, odd long, header string"
PIECES = "file string, split long, line long, whole boolean, opens boolean, text string"


@dataclass(frozen=True)
class Splits:
    """What must be known of the files before their lines can be cut into records."""

    headers: dict[str, str]
    within_quotes: frozenset[tuple[str, int]]
    #: Files with a line that opens or closes a quoted cell of several lines.
    several: frozenset[str]


def _lines(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    find_package(spark)
    rows = spark.read.schema("value string").text(list(paths), lineSep="\n")
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("value").alias("text"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """The runs of rows of one split: its file and start, and the rows from and to."""
    split = batch["split"].to_numpy()
    file = batch["file"].dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero((split[1:] != split[:-1]) | (file[1:] != file[:-1])) + 1
    ends = [*cuts.tolist(), len(split)] if len(split) else []
    for start, stop in zip([0, *ends], ends):
        yield (batch["file"][start].as_py(), int(split[start])), start, stop


def _quotes(text: pa.Array) -> np.ndarray:
    return pc.count_substring(text, '"').to_numpy().astype(np.int64)


def splits(spark: SparkSession, paths: Iterable[str]) -> Splits:
    """One pass over the files: their first lines, and which splits begin within quotes."""
    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, odd, header = None, 0, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"file": now[0], "split": now[1], "odd": odd, "header": header}],
                pa.schema([("file", pa.string()), ("split", pa.int64()), ("odd", pa.int64()), ("header", pa.string())]))
        for batch in batches:
            quotes = _quotes(batch["text"])
            for split, start, stop in _runs(batch):
                if split != now:
                    if now:
                        yield out()
                    now, odd = split, 0
                    header = batch["text"][start].as_py() if split[1] == 0 else None
                odd += int((quotes[start:stop] % 2).sum())
        if now:
            yield out()

    found = materialize(_lines(spark, paths).mapInArrow(summary, SPLITS), "splits")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    begins = found.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).withColumn(
        "several", F.max("odd").over(whole) > 0)
    told = begins.filter("inside OR split = 0").collect()  # one row a file, and a split here and there
    return Splits(
        {r["file"]: r["header"].removesuffix("\r") for r in told if r["split"] == 0},
        frozenset((r["file"], r["split"]) for r in told if r["inside"]),
        frozenset(r["file"] for r in told if r["several"]))


def records(spark: SparkSession, files: Iterable[str], known: Splits) -> DataFrame:
    """Rows (file, record, reason) of ``files`` (as ``known`` names them), their headers and empty lines left out.

    ``reason`` is NULL for a record, and says what is wrong with a line that is part of none.
    """
    inside = known.within_quotes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, odd = None, 0, 0
        for batch in batches:
            quotes = _quotes(batch["text"])
            before, lines = np.zeros(len(quotes), np.int64), np.zeros(len(quotes), np.int64)
            for split, start, stop in _runs(batch):
                if split != now:
                    now, at, odd = split, 0, int(split in inside)
                total = odd + np.cumsum(quotes[start:stop])
                before[start:stop] = total - quotes[start:stop]
                lines[start:stop] = at + np.arange(stop - start)
                at, odd = at + stop - start, int(total[-1])
            opens = before % 2 == 0
            yield pa.RecordBatch.from_arrays(
                [batch["file"], batch["split"], pa.array(lines), pa.array(opens & (quotes % 2 == 0)), pa.array(opens),
                 batch["text"]], ["file", "split", "line", "whole", "opens", "text"])

    def pieces(some: Iterable[str]) -> DataFrame:
        # Spark tells file names as URIs, and reads plain paths.
        return _lines(spark, [unquote(f) for f in some]).mapInArrow(cut, PIECES)

    body = ~((F.col("split") == 0) & (F.col("line") == 0))
    text = F.regexp_replace("text", "\r$", "")
    no_reason = F.lit(None).cast("string").alias("reason")
    whole = pieces(files).filter("whole").filter(body & (F.trim(text) != "")).select("file", text.alias("record"), no_reason)
    some = sorted(set(files) & known.several)
    if not some:
        return whole
    # Lines of records over several lines: few, and numbered by the lines that open one.
    order = Window.partitionBy("file").orderBy("split", "line")
    parts = pieces(some).filter("NOT whole").withColumn("number", F.sum(F.col("opens").cast("int")).over(order))
    parts = materialize(parts.select("file", "split", "line", "number", "text"), "pieces")
    sizes = parts.groupBy("file", "number").agg(F.count("*").alias("n"))
    sizes = materialize(sizes.filter(F.col("n") > MOST_LINES).select("file", "number"), "endless")
    line = F.struct("split", "line", "text")
    several = parts.join(sizes, ["file", "number"], "left_anti").groupBy("file", "number").agg(
        F.array_sort(F.collect_list(line)).alias("lines"))
    joined = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), "\r$", "")
    several = several.select("file", joined.alias("record"), no_reason)
    endless = parts.join(sizes, ["file", "number"], "left_semi").select(
        "file", text.alias("record"), F.lit(UNCLOSED).alias("reason"))
    return whole.unionByName(several).unionByName(endless)
