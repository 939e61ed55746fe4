"""Entity identity: vote for one identifier per name, backfill, pick a display row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.functions import normalize as nz


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def name_votes(*sources: DataFrame) -> DataFrame:
    """(nm, ein, n): how often each name was filed with each identifier.

    Input frames carry ``nm`` and ``ein``. Counting by the pair spreads a name
    that dominates the data over its map-side partial counts.
    """
    pairs = union_all(*[s.select("nm", "ein") for s in sources])
    return (
        pairs.filter(F.col("nm").isNotNull() & F.col("ein").isNotNull())
        .groupBy("nm", "ein")
        .agg(F.count("*").alias("n"))
    )


def spellings(*sources: DataFrame) -> DataFrame:
    """(nm, ein, name, d, n): latest date and row count per way an entity is written.

    Everything identity needs from the filings, in one pass over them; even an
    entity that files most rows is written in a handful of ways.
    """
    rows = union_all(*[s.select("nm", "ein", "name", "d") for s in sources])
    return (
        rows.filter(F.col("nm").isNotNull()).groupBy("nm", "ein", "name")
        .agg(F.max("d").alias("d"), F.count("*").alias("n"))
    )


def votes_of(written: DataFrame) -> DataFrame:
    """The votes of ``name_votes``, from spellings."""
    return written.filter(F.col("ein").isNotNull()).groupBy("nm", "ein").agg(F.sum("n").alias("n"))


def name_id_map(votes: DataFrame) -> DataFrame:
    """(nm, mapped): the most used identifier per name, smallest on a tie."""
    best = F.min_by(F.col("ein"), F.struct(-F.col("n"), F.col("ein")))
    return votes.groupBy("nm").agg(best.alias("mapped"))


def resolve(
    filings: DataFrame, id_map: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda keyed: keyed
) -> DataFrame:
    """Add ``key`` to frames that carry ``nm`` and ``ein``; nameless rows drop.

    A filing with its own identifier is keyed where it lies: only those without one
    meet the map, in a second scan of the frame, which should be stored therefore.

    No hint: the measured size of the map decides between a broadcast and a
    shuffle, and in a shuffle the adaptive skew rule splits the filings of a
    dominating name (the map has one row per name, so only the left side is hot).
    For that the map must be stored: the rule skips a join whose side comes
    straight from an aggregation.

    ``keep`` may store the filings that met the map, for several readers of the result;
    those with an identifier are read where they lie.
    """
    named = filings.filter(F.col("nm").isNotNull())
    own = named.filter(F.col("ein").isNotNull()).withColumn("key", F.col("ein"))
    return own.unionByName(keep(_keyed(named.filter(F.col("ein").isNull()), id_map, "mapped", "key")))


def _keyed(idless: DataFrame, by_name: DataFrame, mapped: str, key: str) -> DataFrame:
    """Filings without an identifier, keyed by what their name maps to, or by its hash."""
    joined = idless.join(by_name.select("nm", mapped), "nm", "left")
    return joined.withColumn(key, nz.entity_key(F.col("ein"), F.col(mapped), F.col("nm"))).drop(mapped)


def map_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(nm, was, mapped): names whose identifier differs between two maps (nm, mapped).

    New names, lost names and flipped votes; NULL where a name has no identifier.
    """
    both = old.withColumnRenamed("mapped", "was").join(new, "nm", "full_outer")
    return both.filter(~F.col("was").eqNullSafe(F.col("mapped"))).select("nm", "was", "mapped")


def rekeyed(filings: DataFrame, changes: DataFrame) -> DataFrame:
    """The filings that a refresh of the map moves, with their ``old_key`` and ``key``.

    Only filings without an identifier whose name is among ``changes`` (``map_changes``)
    are read into the result; all others keep their key. What was summed under
    ``old_key`` has to be taken back and summed under ``key``.
    """
    idless = filings.filter(F.col("nm").isNotNull() & F.col("ein").isNull())
    moved = idless.join(changes, "nm")
    return moved.withColumns({
        "old_key": nz.entity_key(F.col("ein"), F.col("was"), F.col("nm")),
        "key": nz.entity_key(F.col("ein"), F.col("mapped"), F.col("nm")),
    }).drop("was", "mapped")


def latest_per_key(
    rows: DataFrame, key: str, date: str, name: str, own_id: str
) -> DataFrame:
    """One row per key: latest date first, then name, then identifier, NULLs last.

    Rows are first reduced to the latest date per spelling, which is what the
    order looks at, so a key holding most of the data shrinks before it moves.
    """
    spellings = rows.groupBy(key, name, own_id).agg(F.max(date).alias(date))
    order = F.struct(
        F.col(date).isNull(),
        -F.unix_date(date),
        F.col(name),
        F.col(own_id).isNull(),
        F.col(own_id),
    )
    first = F.min_by(F.struct(name, own_id, date), order).alias("_first")
    return spellings.groupBy(key).agg(first).select(key, "_first.*")


def employers(candidates: DataFrame) -> DataFrame:
    """(key, ein, name) from candidate rows (key, ein, name, d)."""
    usable = candidates.filter(F.col("name").isNotNull() & (F.col("name") != ""))
    latest = latest_per_key(usable, "key", "d", "name", "ein")
    return latest.select(
        "key", nz.backfill_id(F.col("ein"), F.col("key")).alias("ein"), "name"
    )


def only_known(facts: DataFrame, entities: DataFrame, key: str = "key") -> DataFrame:
    """Fact rows whose entity exists. Rollups keep their key, so apply this to
    aggregated rows, never to filings."""
    return facts.join(entities.select(key), key, "left_semi")

