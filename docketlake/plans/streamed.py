"""Documents rendered from sorted runs of rows.

A document's rows meet in one task, in order, by a sort within partitions (which spills
to disk); its JSON text is written row by row and its digest taken on the way. Nothing
of a document is collected, so its size is bounded by no task's memory: text beyond
``PIECE`` characters goes out as a further row. A document is its pieces in order, and
the last one carries the digest and size of the whole. All but very large documents
are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.session import find_package

#: Characters of a piece, about; a cell of Arrow or Parquet must stay far below 2 GB.
PIECE = 32 << 20
#: Characters of finished pieces that a task holds before it hands them on.
HELD = 4 << 20

SCHEMA = "key string, piece int, body string, sha256 string, n_bytes long"
ARROW = pa.schema([("key", pa.string()), ("piece", pa.int32()), ("body", pa.string()), ("sha256", pa.string()),
                   ("n_bytes", pa.int64())])


@dataclass(frozen=True)
class Section:
    """A field of the document: an array of rows, or (``by_place``) arrays of rows by place."""

    name: str
    by_place: bool = False


class Text:
    """The text of one document at a time, given out in pieces."""

    def __init__(self, sections: Sequence[Section], piece: int):
        self.sections, self.limit = sections, piece
        self.done: list[tuple] = []
        self.key: str | None = None

    def open(self, key: str, head: str) -> None:
        self.key, self.parts, self.size = key, [], 0
        self.number, self.bytes, self.digest = 0, 0, hashlib.sha256()
        self.section, self.place, self.empty = -1, None, True
        self.write(head[:-1])
        self.comma = head != "{}"

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def row(self, section: int, place: str | None, text: str) -> None:
        self.advance(section)
        by_place = self.sections[section].by_place
        if by_place and place != self.place:
            self.write(f"{'' if self.place is None else '],'}{place}:[")
            self.place, self.empty = place, True
        self.write(text if self.empty else "," + text)
        self.empty = False
        if self.size >= self.limit:
            self.flush(last=False)

    def advance(self, section: int) -> None:
        """Close sections and open the next ones up to this one."""
        while self.section < section:
            self.close()
            self.section += 1
            new = self.sections[self.section]
            self.write(f"{',' if self.comma else ''}\"{new.name}\":{'{' if new.by_place else '['}")
            self.place, self.empty, self.comma = None, True, True

    def close(self) -> None:
        if self.section >= 0:
            by_place = self.sections[self.section].by_place
            self.write(("" if self.place is None else "]") + "}" if by_place else "]")

    def finish(self) -> None:
        if self.key is not None:
            self.advance(len(self.sections) - 1)
            self.close()
            self.write("}")
            self.flush(last=True)
            self.key = None

    def flush(self, last: bool) -> None:
        body = "".join(self.parts)
        raw = body.encode()
        self.digest.update(raw)
        self.bytes += len(raw)
        sealed = (self.digest.hexdigest(), self.bytes) if last else (None, None)
        self.done.append((self.key, self.number, body, *sealed))
        self.parts, self.size, self.number = [], 0, self.number + 1

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.done)) if self.done else [()] * len(ARROW)
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)


def render(batches: Iterator[pa.RecordBatch], sections: Sequence[Section], piece: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, head, section, place, text) in order to pieces of documents."""
    text, held = Text(sections, piece), 0
    for batch in batches:
        for key, head, section, place, row in zip(*(c.to_pylist() for c in batch.columns)):
            if key != text.key:
                text.finish()
                if len(text.done) and held > HELD:
                    yield text.take()
                    held = 0
                text.open(key, head)
            text.row(section, place, row)
            held += len(row)
            if len(text.done) and held > HELD and text.done[-1][3] is None:
                yield text.take()
                held = 0
    text.finish()
    yield text.take()


def json_text(value: Column) -> Column:
    """Compact JSON with explicit nulls."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def json_string(value: Column) -> Column:
    """A string as a JSON string."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def streamed(
    rows: DataFrame, family: str, key: Column, head: Column, sections: Sequence[Section], row: Column,
    order: Sequence[Column], section: Column | None = None, place: Column | None = None,
) -> DataFrame:
    """Documents (family, key, piece, body, sha256, n_bytes), one per key that has rows.

    ``head`` holds the leading fields, the same for all rows of a key; ``row`` is what each
    row adds, to the section of index ``section``, ordered by place and ``order``.
    """
    find_package(rows.sparkSession)
    none = F.lit(None).cast("string")
    keys = [c.alias(f"o{i}") for i, c in enumerate(order)]
    # Rows move with the columns they have; they become text where they have met.
    flat = rows.repartition(key).select(
        key.alias("key"), json_text(head).alias("head"), (F.lit(0) if section is None else section).alias("section"),
        (none if place is None else place).alias("at"), json_text(row).alias("text"), *keys)
    met = flat.sortWithinPartitions("key", "section", "at", *[f"o{i}" for i in range(len(keys))], "text")
    label = F.when(F.col("at").isNotNull(), json_string(F.col("at"))).alias("place")
    ready = met.select("key", "head", "section", label, "text")
    piece = PIECE
    return ready.mapInArrow(lambda batches: render(batches, sections, piece), SCHEMA).select(
        F.lit(family).alias("family"), "key", "piece", "body", "sha256", "n_bytes")
