"""Exact dedup as a stateful stream.

Fingerprints (digest of the normalised text, stable identifier, content locator)
are streamed into keyed state on disk, without expiry: per digest the first row
by identifier, where its content lies, and how many rows had it.  Texts are read
again only for digests that were hit, and compared byte by byte there; where a
digest proves to stand for several texts, its rows are grouped by the full text.

State lives in RocksDB below the job's checkpoint; later files added to the same
stream meet the state of earlier ones.  The state holds no texts.

Defined results: null text is the empty text, and equal to it; rows without an
identifier come after all others; rows that repeat identifier and text are
copies of which the first by locator stays; an empty table gives no rows; other columns
may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.work import WorkTables, join_groups
from .common import broadcast_if, filed, placed_rows, rows_except

SPACES = r"[\x20\x09-\x0D]+"
FILES_PER_TRIGGER = 4096
_STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: no disk set aside ahead of need
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # all stores of an executor share one bound
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keeper() -> Column:
    """Identifier and locator; the smallest of a group is the row that stays."""
    return F.struct(
        F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"),
        F.col("_file").alias("file"), F.col("_row").alias("row"),
    )


def fingerprints(docs: DataFrame, digest=sha256) -> DataFrame:
    """(digest, keeper) rows of located documents."""
    text = normalised(F.col("_text"))
    return docs.select(digest(text).alias("digest"), _keeper().alias("keeper"))


def stream_state(
    spark: SparkSession, path: str, checkpoint: str, updates: str, files: int = FILES_PER_TRIGGER
) -> DataFrame:
    """Run the stream over all fingerprint files not seen before; the state as
    rows (digest, keeper, group_size).  May be called again when files were added."""
    schema = spark.read.parquet(path).schema
    state = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
        .groupBy("digest")
        .agg(F.min("keeper").alias("keeper"), F.count("*").alias("group_size"))
    )

    def publish(batch: DataFrame, number: int) -> None:
        # one folder per batch: a batch that is run again replaces its own
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    before = {name: spark.conf.get(name, None) for name in _STATE_SETTINGS}
    for name, value in _STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        run = (
            state.writeStream.outputMode("update").foreachBatch(publish)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        run.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    # keepers only get smaller and sizes larger, so the last update of a digest is
    # its minimum and maximum
    return (
        spark.read.schema(state.schema).option("recursiveFileLookup", "true").parquet(updates)
        .groupBy("digest")
        .agg(F.min("keeper").alias("keeper"), F.max("group_size").alias("group_size"))
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256,
    files: int = FILES_PER_TRIGGER, work: WorkTables | None = None,
) -> DataFrame:
    """Per row of ``docs``: id, file, row (its place), keep_id, group_size, kept, digest."""
    spark = docs.sparkSession
    work = work or WorkTables(spark)
    rows = placed_rows(filed(docs, work), _id=F.col(id_col), _text=F.col(text_col)).withColumnsRenamed(
        {"file": "_file", "row": "_row"}
    )
    prints = work.keep(fingerprints(rows, digest), "fingerprints")
    total = prints.count()
    if total == 0:
        return prints.select(*_result(F.col("keeper"), F.lit(0).cast("long")))
    base = f"{work.folder}/stream"
    state = work.keep(
        stream_state(spark, work.path(prints), f"{base}/state",
                     f"{base}/updates", files),
        "keepers",
    ).withColumnRenamed("keeper", "first")

    own = join_groups(prints, state, "digest", "group_size", total)
    hits = state.filter("group_size > 1").agg(F.sum("group_size")).first()[0] or 0
    if hits:
        texts = _hit_texts(rows, prints, state, hits, digest)
        # equal bytes meet in one row; a digest with several rows stands for several texts
        by_bytes = texts.groupBy("digest", "text").agg(
            F.min("keeper").alias("first"), F.count("*").alias("group_size")
        )
        wrong = work.keep(
            by_bytes.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1"), "collisions"
        )
        if not wrong.isEmpty():
            split = texts.join(wrong.select("digest"), "digest", "left_semi").join(
                by_bytes, ["digest", "text"]
            )
            own = own.join(wrong.select("digest"), "digest", "left_anti").unionByName(
                split.drop("text")
            )
    return own.select(*_result(F.col("first"), F.col("group_size")))


def _hit_texts(rows, prints, state, hits, digest) -> DataFrame:
    """Normalised texts of the rows whose digest was hit, fetched by locator."""
    hit = state.filter("group_size > 1").select("digest")
    places = prints.join(hit, "digest", "left_semi").select(
        F.col("keeper.file").alias("_file"), F.col("keeper.row").alias("_row")
    )
    found = rows.join(broadcast_if(places, hits), ["_file", "_row"], "left_semi")
    text = normalised(F.col("_text"))
    return found.select(digest(text).alias("digest"), text.alias("text"), _keeper().alias("keeper"))


def _result(first: Column, size: Column) -> list[Column]:
    return [
        F.col("keeper.id").alias("id"), F.col("keeper.file").alias("file"),
        F.col("keeper.row").alias("row"), first["id"].alias("keep_id"),
        size.alias("group_size"), (F.col("keeper") == first).alias("kept"),
        F.col("digest"),
    ]


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    work = WorkTables(docs.sparkSession)
    docs = filed(docs, work)
    groups = work.keep(exact_groups(docs, id_col, text_col, work=work), "groups")
    return rows_except(docs, groups.filter(~F.col("kept")))
