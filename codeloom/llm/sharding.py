"""Sharding of records by weighted rendezvous hashing, in DataFrame expressions only.

Each (key, shard) pair draws a score ``-ln(u) / weight`` from a hash of both; the
record goes to the shard with the smallest score.  A further shard takes a record
only if its own score is smaller, so records move into the new shard alone, and a
shard's share is proportional to its weight.

Defined results: a null key hashes like any other key; null text has no bytes;
repeated keys go to one shard and get slots of their own; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.work import WorkTables, dense_index

# Added to every record's size: its key.
KEY_BYTES = 8


def _draw(key: Column, shard: int, weight: float) -> Column:
    """Exponential draw of one (key, shard) pair, with the shard for ties."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12)
    u = (bits.cast("double") + 0.5) / float(1 << 52)
    return F.struct((-F.ln(u) / weight).alias("score"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of a key among weighted shards 0 .. len(weights) - 1."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    return F.array_min(F.array(*[_draw(key, s, w) for s, w in enumerate(weights)]))["shard"]


def assign_shards(
    df: DataFrame,
    weights: Sequence[float],
    key: str = "doc_id",
    text: str = "text",
    work: WorkTables | None = None,
) -> DataFrame:
    """Per record: key, size, text_crc32, shard, slot in the shard, and the shard it
    would have if one more of the mean weight were added.

    Slots count a shard's records in key order.  They come from range partitions of
    narrow rows, so no shard is gathered in one task.
    """
    work = work or WorkTables(df.sparkSession)
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    grown = [*weights, sum(weights) / len(weights)]
    narrow = df.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + F.lit(KEY_BYTES)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    placed = work.keep(narrow, "sizes").select(
        "*",
        rendezvous(F.col("key"), weights).alias("shard"),
        rendezvous(F.col("key"), grown).alias("grown_shard"),
    )
    return dense_index(placed, ["shard"], ["key"], "slot", work)


def write_shards(
    df: DataFrame, weights: Sequence[float], path: str, key: str = "doc_id"
) -> None:
    """Whole records, one folder per shard, without a shuffle."""
    df.withColumn("shard", rendezvous(F.col(key), weights)).write.partitionBy("shard").parquet(path)
