"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.work import BROADCAST_ROWS, WorkTables, dense_index

# Rows of one Arrow batch: a Python worker holds one batch of whole texts.
ARROW_ROWS = 128


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once; texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Jobs run inside hold at most ``rows`` rows in a Python worker's batch; the session's
    own setting is back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def map_rows(
    df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, list] | None], schema: str
) -> DataFrame:
    """``mapInArrow`` with a function from a batch to columns of Python values."""
    fields = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (columns := make(batch)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], f.type) for f in fields], schema=fields
                )
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """A Python worker lives on after its task, beside the executor's own memory: what the
    task's texts took goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what is freed
    if trim:
        trim(0)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def filed(docs: DataFrame, work: WorkTables) -> DataFrame:
    """``docs`` itself if its rows come straight from files, else a written copy."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
        return docs
    except AnalysisException:
        return work.keep(docs, "filed")


def placed_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """The given columns of ``docs`` (see ``filed``) with ``file`` and ``row``, where each row was
    read; other columns, whatever their names, are left out.

    The place identifies a row even where ids repeat, and stays the same however
    often the table is read.
    """
    meta = docs.metadataColumn("_metadata")
    return docs.select(
        *[c.alias(name) for name, c in columns.items()],
        meta["file_path"].alias("file"), meta["row_index"].alias("row"),
    )


def rows_except(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` (see ``filed``) without the rows at the places (file, row) in ``gone``; its own
    columns may have any names."""
    taken = {c.lower() for c in docs.columns}
    file, row = (next(n for i in range(len(taken) + 1) if (n := f"{c}{i}") not in taken) for c in ("file", "row"))
    meta = docs.metadataColumn("_metadata")
    placed = docs.select("*", meta["file_path"].alias(file), meta["row_index"].alias(row))
    gone = gone.select(F.col("file").alias(file), F.col("row").alias(row))
    return placed.join(broadcast_if(gone, gone.count()), [file, row], "left_anti").drop(file, row)


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast up to BROADCAST_ROWS counted rows of numbers; shuffle beyond."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def learn_from(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from; the others are held out.  A row without an
    identifier is not held out; it has no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(True))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def item_blocks(
    items: DataFrame, key: str, text: str, work: WorkTables, limit: int, together: int
) -> tuple[DataFrame, int]:
    """(item_id, text, block, place) in blocks of ``limit`` bytes of text, give or take
    ``together`` items, and how many blocks there are."""
    rows = items.select(
        F.col(key).alias("item_id"), F.col(text).alias("text"),
        F.octet_length(F.coalesce(F.col(text), F.lit(""))).alias("bytes"),
    ).withColumn("_at", F.monotonically_increasing_id())
    placed = work.keep(dense_index(work.keep(rows, "item-rows"), [], ["item_id", "_at"], "place", work), "items")
    chunk = F.floor(F.col("place") / together)
    # a row per so many items
    sums = placed.groupBy(chunk.alias("chunk")).agg(F.sum("bytes").alias("bytes"))
    before = F.sum("bytes").over(W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    numbered = sums.select(
        "chunk", F.floor(F.coalesce(before, F.lit(0)) / limit).alias("block")
    )
    blocks = work.keep(
        placed.withColumn("chunk", chunk).join(numbered, "chunk").select("item_id", "text", "block", "place"),
        "item-blocks",
    )
    last = blocks.agg(F.max("block")).first()[0]
    return blocks, 0 if last is None else last + 1
