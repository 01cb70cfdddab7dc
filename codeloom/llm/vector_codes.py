"""Vector code compression: product codes whose nearest entries are found by Orchard search.

A vector's components become integers ``floor(scale * x)`` and are cut into equal
parts; each part position has a codebook of integer entries, fitted in rounds of
exact sums, so that results do not depend on partitioning.  A part's nearest entry
is found with a list of all entries per entry, sorted by distance from it: the
search walks the current entry's list, jumps to the list of a nearer entry as soon as
it meets one, skips visited entries, and stops beyond twice the current distance,
where the triangle inequality leaves nothing nearer (or as near with a lower index).

Every round reads the vectors where they are; tasks send sums per (part, entry,
place), whose number depends on the codebooks alone.

Defined results: rows are dropped whose vector is null, empty, holds null or
non-finite components, has a length that the parts do not divide, or another length
than the first kept vector; null identifiers come last and repeated rows count as
often as they occur; with fewer vectors than entries the codebooks are shorter; an
empty table gives no rows; other columns are not looked at.  Sums and distances are
exact at any magnitude; an error beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.work import WorkTables, join_groups
from .common import arrow_schema, bounded_batches

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BATCH_ROWS = 1024
# Squared distances of parts within these bounds fit 64-bit integers.
_SAFE = 1 << 26
_SAFE_WIDTH = 128
# A sum travels as digits of this base, each in a long.
_DIGIT = 1 << 31


@dataclass
class Codebooks:
    """``entries[part][entry]`` is a list of integers."""

    entries: list[list[list[int]]]

    @property
    def length(self) -> int:
        return sum(len(book[0]) for book in self.entries)

    def text(self) -> str:
        return ",".join(str(x) for book in self.entries for entry in book for x in entry)


def _kept(vector: Column, parts: int, length: int | None = None) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    same = F.size(vector) == length if length else (F.size(vector) > 0) & (F.size(vector) % parts == 0)
    return vector.isNotNull() & same & ~bad


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """Rows of integers; Python's own where 64 bits may not hold a distance."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if np.abs(scaled).max(initial=0) <= _SAFE and values.shape[1] <= _SAFE_WIDTH * PARTS:
        return scaled.astype(np.int64)
    exact = np.empty(values.shape, dtype=object)
    for at, x in np.ndenumerate(values.astype(np.float64)):
        top, bottom = float(x).as_integer_ratio()
        exact[at] = top * scale // bottom
    return exact


class Orchard:
    """Nearest entries of one codebook."""

    def __init__(self, book: list[list[int]]):
        wide = max((abs(x) for entry in book for x in entry), default=0) > _SAFE
        self.book = np.array(book, dtype=object if wide else np.int64)
        apart = ((self.book[:, None, :] - self.book[None, :, :]) ** 2).sum(axis=2)
        # by distance, then index; an entry's own list starts with itself
        self.lists = np.array(
            [sorted(range(len(book)), key=lambda e, c=c: (apart[c][e], e != c, e)) for c in range(len(book))]
        )
        self.reach = np.take_along_axis(apart, self.lists, axis=1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row; of equal distances the lower entry."""
        n, k = len(rows), len(self.book)
        entry = np.zeros(n, dtype=np.int64)
        best = ((rows - self.book[0]) ** 2).sum(axis=1)
        place = np.ones(n, dtype=np.int64)
        visited = np.zeros((n, k), dtype=bool)
        visited[:, 0] = True
        left = np.arange(n) if k > 1 else np.arange(0)
        while len(left):
            at, spot = entry[left], place[left]
            within = self.reach[at, spot] <= 4 * best[left]
            left, at, spot = left[within], at[within], spot[within]
            found = self.lists[at, spot]
            place[left] += 1
            new = ~visited[left, found]
            asked, tried = left[new], found[new]
            visited[asked, tried] = True
            apart = ((rows[asked] - self.book[tried]) ** 2).sum(axis=1)
            nearer = (apart < best[asked]) | ((apart == best[asked]) & (tried < entry[asked]))
            moved = asked[nearer]
            entry[moved], best[moved], place[moved] = tried[nearer], apart[nearer], 1
            left = left[place[left] < k]
        return entry, best


def _batches(batches: Iterator[pa.RecordBatch], column: str, scale: int, length: int):
    """(batch, its vectors as integer rows)."""
    for batch in batches:
        if batch.num_rows:
            flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
            yield batch, quantised(flat.reshape(-1, length), scale)


def _digits(value: int) -> list[int]:
    sign, value, digits = (-1 if value < 0 else 1), abs(value), []
    while value or not digits:
        value, digit = divmod(value, _DIGIT)
        digits.append(sign * digit)
    return digits


def _next_round(vectors: DataFrame, books: Codebooks, scale: int) -> Codebooks:
    """Codebooks after one assignment; entries without parts stay."""
    schema = "part int, entry int, place int, digit int, value long"
    fields, length = arrow_schema(vectors.sparkSession, schema), books.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Orchard(book) for book in books.entries]
        width = length // len(searches)
        sums = np.zeros((len(searches), len(searches[0].book), width + 1), dtype=object)
        for _, rows in _batches(batches, "vector", scale, length):
            for p, search in enumerate(searches):
                part = rows[:, p * width : (p + 1) * width]
                entry, _ = search.nearest(part)
                for e in np.unique(entry):
                    own = part[entry == e]
                    sums[p, e, :width] += own.sum(axis=0).astype(object)
                    sums[p, e, width] += len(own)
        out = [
            (p, e, place, digit, value)
            for (p, e, place), total in np.ndenumerate(sums) if sums[p, e, width]
            for digit, value in enumerate(_digits(int(total)))
        ]
        if out:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), fields)]
            yield pa.RecordBatch.from_arrays(columns, schema=fields)

    totals: dict[tuple[int, int], list[int]] = {}
    width = length // len(books.entries)
    # as many rows as the codebooks have numbers (a few digits each)
    for r in (
        vectors.select("vector").mapInArrow(run, schema)
        .groupBy("part", "entry", "place", "digit").agg(F.sum("value").alias("value")).collect()
    ):
        total = totals.setdefault((r.part, r.entry), [0] * (width + 1))
        total[r.place] += r.value * _DIGIT**r.digit
    return Codebooks([
        [
            [x // totals[p, e][width] for x in totals[p, e][:width]] if (p, e) in totals else entry
            for e, entry in enumerate(book)
        ]
        for p, book in enumerate(books.entries)
    ])


def _usable(df: DataFrame, vector: str, parts: int, length: int | None = None) -> DataFrame:
    if not isinstance(df.schema[vector].dataType, ArrayType):
        raise TypeError(f"{vector} is no array column")
    return df.filter(_kept(F.col(vector), parts, length))


def fit(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> Codebooks | None:
    """Codebooks of all kept vectors, started from those of the smallest identifiers;
    None where no vector is kept."""

    def smallest(length: int | None, n: int) -> list:
        rows = _usable(df, vector, parts, length).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
        return rows.orderBy(F.col("key").asc_nulls_last(), "vector").limit(n).collect()

    first = smallest(None, 1)
    if not first:
        return None
    length = len(first[0].vector)
    start = quantised(np.array([r.vector for r in smallest(length, entries)], dtype=np.float64), scale)
    width = length // parts
    books = Codebooks([
        [[int(x) for x in row[p * width : (p + 1) * width]] for row in start] for p in range(parts)
    ])
    vectors = _usable(df, vector, parts, length).select(F.col(vector).alias("vector"))
    with bounded_batches(df.sparkSession, BATCH_ROWS):
        for _ in range(rounds):
            books = _next_round(vectors, books, scale)
    return books


def encode(
    df: DataFrame, books: Codebooks | None, key: str = "vec_id", vector: str = "embedding",
    label: str = "label", scale: int = SCALE,
) -> DataFrame:
    """Per kept row: id, label, code (an entry number per part, two hex digits each or as
    many as the largest number has), error (squared distance of all parts)."""
    parts = len(books.entries) if books else PARTS
    usable = _usable(df, vector, parts, books.length if books else None).select(
        F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")
    )
    if books is None:
        none = usable.filter(F.lit(False)).drop("vector")
        return none.select("*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    id_type, label_type = (usable.schema[c].dataType.simpleString() for c in ("id", "label"))
    schema = f"id {id_type}, label {label_type}, code string, error long"
    fields, length = arrow_schema(df.sparkSession, schema), books.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Orchard(book) for book in books.entries]
        width = length // len(searches)
        digits = max(2, len(f"{len(searches[0].book) - 1:x}"))
        names = [f"{e:0{digits}x}" for e in range(len(searches[0].book))]
        for batch, rows in _batches(batches, "vector", scale, length):
            found = [s.nearest(rows[:, p * width : (p + 1) * width]) for p, s in enumerate(searches)]
            codes = ["".join(names[e] for e in row) for row in zip(*(entry for entry, _ in found))]
            errors = [sum(map(int, row)) for row in zip(*(best for _, best in found))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").cast(fields.field("id").type),
                    batch.column("label").cast(fields.field("label").type),
                    pa.array(codes, pa.string()),
                    pa.array([e if e < 1 << 63 else None for e in errors], pa.int64()),
                ],
                schema=fields,
            )

    return usable.mapInArrow(run, schema)


def with_label_errors(coded: DataFrame, work: WorkTables | None = None) -> DataFrame:
    """``encode``'s rows with label_error, the error of all rows of the same label (null
    is a label of its own).  Hot labels are not shuffled."""
    work = work or WorkTables(coded.sparkSession)
    with bounded_batches(coded.sparkSession, BATCH_ROWS):
        coded = work.keep(coded, "codes")
    coded = coded.withColumn("_label", F.struct("label"))
    labels = work.keep(
        coded.groupBy("_label").agg(
            F.try_sum("error").alias("label_error"), F.count("*").alias("_size")
        ),
        "labels",
    )
    total = labels.agg(F.sum("_size")).first()[0] or 0
    return join_groups(coded, labels, "_label", "_size", total).drop("_label", "_size")
