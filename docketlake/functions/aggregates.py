"""Aggregate expressions shared by the rollups.

Averages are a decimal sum over a count, so the rounded result does not depend
on the order in which rows arrive.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_mean(total: Column, n: Column, scale: int) -> Column:
    """``total / n`` rounded half up; NULL when nothing was counted."""
    quotient = total / F.nullif(n.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.round(quotient, scale)


def count_where(condition: Column) -> Column:
    """Rows where the condition is true; unknown counts as not."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def label_counts(label: Column, domain: Sequence[str], default: str) -> list[tuple[str, Column]]:
    """One counting column per label of a closed domain, ``default`` for NULL.

    A closed domain needs no second aggregation and no collected list.
    """
    named = [(value, count_where(label == value)) for value in domain]
    return [*named, (default, count_where(label.isNull()))]


def counts_to_map(pairs: Sequence[tuple[str, Column]]) -> Column:
    """label -> count, for labels that occur; NULL when none does."""
    def entry(k: str, v: Column) -> Column:
        occurs = F.when(v > 0, F.lit(1)).otherwise(F.lit(0))
        return F.slice(F.array(F.struct(F.lit(k).alias("k"), v.alias("v"))), F.lit(1), occurs)
    any_occurs = reduce(lambda a, b: a | b, [F.coalesce(v > 0, F.lit(False)) for _, v in pairs])
    entries = F.flatten(F.array(*[entry(k, v) for k, v in sorted(pairs, key=lambda pair: pair[0])]))
    return F.when(any_occurs, F.map_from_entries(entries))


def ordered_array(*fields: Column) -> Column:
    """An array of objects, ordered by the fields from left to right."""
    return F.sort_array(F.collect_list(F.struct(*fields)))
