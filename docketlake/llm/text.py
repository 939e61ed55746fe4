"""Text columns as Arrow batches: bounded slices, words, folds and samples.

Everything here works on whole texts. A null text is an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.session import materialize

#: Bytes of text handled at a time inside a task. A longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Rows of each group that a sample of many groups has at least.
LEAST_ROWS = 50


def fold(key: str, folds: int) -> Column:
    """crc32 of an identifier as text, modulo ``folds``; 0 for a null identifier."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def add_free(docs: DataFrame, column: Column) -> tuple[DataFrame, str]:
    """``docs`` with a column under a name that it does not have yet, and that name."""
    name = "_p"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, column), name


def give_back() -> None:
    """Return freed memory to the system: workers live for many tasks, and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc(), "malloc_trim", None)
    if trim:
        trim(0)


@lru_cache(maxsize=1)
def _libc():
    return ctypes.CDLL(None)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The texts in order, in runs of at most ``limit`` bytes where texts allow."""
    texts = pc.fill_null(column, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield texts.slice(start, stop - start)
        start = stop
    give_back()


class Words:
    """The white-space separated words of a run of texts.

    ``distinct``: the different words; ``ids``: one index into them per word, in
    order; ``ends``: per text, where its words end in ``ids``. White space is the
    six ASCII characters.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        offsets = lists.offsets.to_numpy()
        flat = lists.flatten().dictionary_encode()
        self.distinct = flat.dictionary
        ids = flat.indices.to_numpy()
        keep = pc.binary_length(self.distinct).to_numpy(zero_copy_only=False)[ids] > 0 if len(ids) else np.zeros(0, bool)
        before = np.concatenate([[0], np.cumsum(keep)])
        self.ends = before[offsets[1:] - offsets[0]].astype(np.int64)
        self.ids = ids[keep]

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)


def sampled(rows: DataFrame, group: str, per_group: int, salt: str, most_groups: int = 64) -> DataFrame:
    """About ``per_group`` rows of each value of ``group``, chosen by a hash of the rows.

    The choice depends on the rows alone, so a repeated task makes it again. The
    groups are counted first and the counts broadcast, so that no row is shuffled by
    group. No group is left out: above ``most_groups`` all share the rows of that many,
    with at least ``LEAST_ROWS`` each. ``per_group * most_groups`` is a hard bound on the
    result up to that, and twice the shares above.
    """
    order = F.xxhash64(F.lit(salt), *[F.col(f"`{c}`") for c in rows.columns])
    counts = materialize(rows.filter(F.col(group).isNotNull()).groupBy(group).count(), "sample-counts")
    n, bound = counts.count(), per_group * most_groups
    if n > most_groups:
        per_group = min(per_group, max(bound // n, LEAST_ROWS))
        bound = 2 * per_group * n
    counts = F.broadcast(counts.withColumnRenamed(group, "_g"))
    share = F.lit(float(per_group)) / F.col("count")
    unit = F.shiftrightunsigned(order, 11) / F.lit(float(1 << 53))
    picked = rows.join(counts, F.col(group) == F.col("_g")).filter(unit < share)
    return (picked.withColumn("_order", order).orderBy("_order").limit(bound)
            .drop("_g", "count", "_order"))
