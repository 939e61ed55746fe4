"""Token counts by source, language and tokenizer version, kept up to date by deltas.

A batch is a set of signed changes of documents: ``insert`` adds what ``after``
counts, ``delete`` takes away what ``before`` counts, ``revise`` does both. A batch
becomes a small rollup of signed sums, which is written under the batch's name and
committed by one rename. A batch that is already committed is not added again, and a
commit that was cut off leaves nothing behind that counts. Totals are sums over the
committed batches, so batches may be committed in any order; ``compact`` folds
committed batches into one without changing a total.

Nulls: a null source or language is a group of its own; a null count is zero; a
missing side of a change (a delete without ``before``) is no change. Groups whose
documents are all gone stay with zeros until they are compacted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "version")
SUMS = ("n_docs", "n_tokens", "n_bytes")
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long, n_bytes long"


def words(text: str | Column) -> Column:
    """How many white-space separated words a text has; white space is the six ASCII characters."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def side(version: str | Column, n_tokens: Column, n_bytes: Column, source="source", lang="lang") -> Column:
    """One side of a change: where a document is counted, and how much."""
    version = F.lit(version) if isinstance(version, str) else version
    return F.struct(F.col(source).alias("source"), F.col(lang).alias("lang"), version.alias("version"),
                    n_tokens.cast("long").alias("n_tokens"), n_bytes.cast("long").alias("n_bytes"))


def deltas(changes: DataFrame) -> DataFrame:
    """Changes (op, before, after) to signed sums per group.

    Sums combine on the map side: a source with most of the rows moves as one row
    per task.
    """
    takes, gives = F.col("op").isin("delete", "revise"), F.col("op").isin("insert", "revise")
    signed = F.array_compact(F.array(
        F.when(takes & F.col("before").isNotNull(), F.struct(F.lit(-1).alias("sign"), F.col("before").alias("c"))),
        F.when(gives & F.col("after").isNotNull(), F.struct(F.lit(1).alias("sign"), F.col("after").alias("c"))),
    ))
    rows = changes.select(F.explode(signed).alias("x")).select("x.sign", "x.c.*")
    return rows.groupBy(*KEYS).agg(
        F.sum(F.col("sign").cast("long")).alias("n_docs"),
        *[F.sum(F.col("sign") * F.coalesce(n, F.lit(0))).alias(n) for n in SUMS[1:]])


class Rollup:
    """A folder of committed batches, on any store that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._path("/".join([self.folder, *parts]))

    def batches(self) -> list[str]:
        """Names of the committed batches; they are few beside what they count."""
        if not self._fs.exists(self._at("batches")):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("batches")))

    def folded(self) -> set[str]:
        """Names of batches that a committed compaction holds."""
        names = set()
        for name in self.batches():
            if self._fs.exists(self._at("batches", name, "_folded")):
                names |= {r[0] for r in self.spark.read.parquet(f"{self.folder}/batches/{name}/_folded").collect()}
        return names

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch once; False if it was committed before."""
        if not batch or batch[0] in "._" or "/" in batch:
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.batches() or batch in self.folded():
            return False
        return self._publish(batch, deltas(changes))

    def _publish(self, batch: str, rows: DataFrame, folded: list[str] | None = None) -> bool:
        aside = f"{self.folder}/aside/{uuid.uuid4().hex}"
        rows.write.parquet(f"{aside}/sums")  # one row per group; groups stay where they were summed
        if folded is not None:
            self.spark.createDataFrame([(b,) for b in folded], "batch string").coalesce(1).write.parquet(f"{aside}/_folded")
        self._fs.mkdirs(self._at("batches"))
        if self._fs.exists(self._at("batches", batch)) or not self._fs.rename(self._path(aside), self._at("batches", batch)):
            self._fs.delete(self._path(aside), True)
            return False
        # A rename onto a folder that another writer just made puts ours inside it: take it out.
        inside = self._at("batches", batch, aside.rsplit("/", 1)[1])
        if self._fs.exists(inside):
            self._fs.delete(inside, True)
            return False
        return True

    def totals(self) -> DataFrame:
        """Sums over the committed batches; a batch that a compaction holds counts there."""
        gone = self.folded()
        parts = [f"{self.folder}/batches/{b}/sums" for b in self.batches() if b not in gone]
        rows = self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(*[F.sum(n).alias(n) for n in SUMS])

    def compact(self, name: str) -> bool:
        """Fold all committed batches into one of the given name."""
        names = sorted({*self.batches(), *self.folded()})
        if not names or name in names:
            return False
        rows = self.totals().filter(" or ".join(f"{n} <> 0" for n in SUMS))
        if not self._publish(name, rows, names):
            return False
        for old in names:
            self._fs.delete(self._at("batches", old), True)
        return True
