"""Where intermediate tables are written, and small join helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A per-repository table is broadcast only up to this many rows (a few hundred
# bytes each at most); beyond it the join is shuffled.
BROADCAST_ROWS = 200_000
# A group with at least 1/HEAVY_SHARE of all rows is heavy; by counting there are
# at most HEAVY_SHARE of them, whatever the input's size.
HEAVY_SHARE = 1000
# Rows of ids and names that one task groups or sorts at a time.
ROWS_PER_TASK = 1_000_000
# Rows of numbers that one task joins and groups sooner than a shuffle deals them out.
FEW_ROWS = 200_000


def work_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared folder of ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        base = context.getCheckpointDir()
        if not base:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            base = tempfile.mkdtemp(prefix="codeloom-")
            context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/codeloom-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back: cuts lineage, survives executor loss,
    and gives the optimiser real sizes."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class WorkTables:
    """Written tables of one job.  ``keep`` never reuses a path; ``alternate``
    reuses two slots per name, so that a long loop holds two generations on
    disk, not all of them.  Each loop works in a ``child`` of its own."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or work_folder(spark)
        self._count = 0
        self._turn: dict[str, int] = {}
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def child(self) -> WorkTables:
        return WorkTables(self.spark, f"{self.folder}/{uuid.uuid4().hex[:12]}")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self._count += 1
        path = f"{self.folder}/{self._count:04d}-{name}"
        table = written(df, path)
        self._paths[id(table)] = (table, path)
        return table

    def path(self, table: DataFrame) -> str:
        """Where a table that ``keep`` returned lies."""
        return self._paths[id(table)][1]

    def discard(self, *tables: DataFrame) -> None:
        """Delete written tables of this job that nothing reads any more: whatever was made
        from them has itself been written."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for table in tables:
            path = hadoop(self._paths.pop(id(table))[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def alternate(self, df: DataFrame, name: str) -> DataFrame:
        turn = self._turn.get(name, 0)
        self._turn[name] = turn + 1
        return written(df, f"{self.folder}/{name}-{turn % 2}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side whose row count is known to be small, else leave the
    join to a shuffle (adaptive execution splits its hot keys)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shuffled(df: DataFrame) -> DataFrame:
    """A side that grows with the input, joined by a shuffle: a written table of ids takes a
    twentieth of its rows' size on disk, by which the optimiser would broadcast millions of
    rows through the driver."""
    return df.hint("merge")


def dealt(df: DataFrame, rows: int | None, *keys) -> DataFrame:
    """Rows dealt by keys to one task per ROWS_PER_TASK of them, so that what a task holds does
    not grow with the input, whatever the session's number of shuffle partitions.  What follows
    needs no shuffle of its own for these keys.  Without a count they stay where they are."""
    if rows is None:
        return df
    return df.repartition(tasks_of(df.sparkSession, rows), *keys)


def tasks_of(spark: SparkSession, rows: int) -> int:
    """One task per ROWS_PER_TASK rows, and as many as run at once at least."""
    least = min(partitions(spark), spark.sparkContext.defaultParallelism)
    return max(least, -(-rows // ROWS_PER_TASK))


def laid_out(df: DataFrame, parts: int, key: str) -> DataFrame:
    """Rows in so many partitions by a key, which meet other such rows without a shuffle.  One
    partition needs none at all: joins and aggregates that follow run in its task."""
    return df.coalesce(1) if parts == 1 else df.repartition(parts, key)


def distinct_rows(df: DataFrame, rows: int | None) -> DataFrame:
    """``distinct`` of so many rows, of which few are alike: each is dealt out as it is and
    sorted by one number, which takes no table of all of a task's rows.  Without a count
    rows that are alike are one row before they are dealt out."""
    if rows is None:
        return df.distinct()
    alike = W.partitionBy("_key", *df.columns).orderBy("_key")
    return (
        dealt(df, rows, *df.columns).withColumn("_key", F.xxhash64(*df.columns))
        .withColumn("_at", F.row_number().over(alike)).filter("_at = 1").select(*df.columns)
    )


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Rows with their group's columns (one row of ``groups`` per key, ``size`` rows in it).

    Heavy groups, at most HEAVY_SHARE by counting, are broadcast, so that their
    rows stay where they are; only rows of light groups are shuffled.
    """
    is_heavy = F.col(size) * HEAVY_SHARE >= F.lit(total)
    heavy, light = groups.filter(is_heavy), groups.filter(~is_heavy)
    return rows.join(F.broadcast(heavy), key).unionByName(
        rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    )


def dense_index(
    df: DataFrame, group: list[str], order: list[str], name: str, work: WorkTables
) -> DataFrame:
    """0-based position of each row within its group, in the given order; the
    order columns are unique within a group.

    A window would sort a whole group in one task.  Here rows are range
    partitioned and sorted on (group, order), so a row's place in its partition
    is known as it is written, and only the partitions' counts per group are
    summed up.  A hot group is spread over as many partitions as it fills.
    """
    keys = [F.col(c) for c in [*group, *order]]
    placed = work.keep(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()),
        f"{name}-sorted",
    )
    # the id's upper bits are the partition, its lower 33 the row within it
    placed = placed.withColumn("_slice", F.shiftright("_at", 33)).withColumn(
        "_row", F.col("_at").bitwiseAND((1 << 33) - 1)
    )
    counts = placed.groupBy(*group, "_slice").agg(
        F.min("_row").alias("_first"), F.count("*").alias("_n")
    )
    earlier = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(
        *group,
        "_slice",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return (
        placed.join(shifts, [*group, "_slice"])
        .withColumn(name, F.col("_row") + F.col("_shift"))
        .drop("_at", "_slice", "_row", "_shift")
    )
