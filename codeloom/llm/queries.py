"""Registered queries of this subpackage, one per operator, over whole tables.

Each query calls its operator and derives the columns of its contract from the
operator's rows.  CHECKS holds the SQL of those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.work import WorkTables
from . import bpe, chat, quality, secret_scan, toxicity, vector_codes, warc
from . import check_sql as sql
from .common import learn_from, read
from .decontaminate import contamination
from .dedup import exact_groups
from .lexical import search
from .minmax import near_duplicates
from .mixing import mix
from .sharding import assign_shards

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, tuple[Query, str | None]] = {}

SHARDS = 24


def query(name: str, check: str | None = None):
    def add(fn: Query) -> Query:
        REGISTERED[name] = (fn, check)
        return fn

    return add


@query("op2_exact_dedup", sql.EXACT_DEDUP)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(read(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(read(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return placed.select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"),
        "shard", "slot", "grown_shard",
    )


@query("op4_minmax_near_dedup", sql.NEAR_DEDUP)
def op4_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), percent=85)
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
        (F.col("component") == F.col("id")).alias("kept"),
    )


@query("op7_decontamination", sql.DECONTAMINATION)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe.round_trip(read(spark, sf_dir, "documents"), path)
    return found.select(
        F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"),
    )


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    return _predicted(scored, 0.5)


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return _predicted(scored, 0.7)


def _predicted(scored: DataFrame, least: float) -> DataFrame:
    return scored.select(
        F.col("id").alias("doc_id"), (~learn_from(F.col("id"))).alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "novel")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col("id").alias("doc_id"), count("assign").alias("n_assign"),
        count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined_spans(base), 256).alias("base_sha256"),
        _joined_spans(F.col("spans")).alias("spans"), count("novel").alias("n_novel"),
    )


def _joined_spans(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


@query("op10_warc", sql.WARC)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = WorkTables(spark)
    archives = f"{work.folder}/archives"
    warc.write_archives(read(spark, sf_dir, "pages"), archives, work=work)
    return warc.read_records(spark, archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op11_vector_codes", sql.VECTOR_CODES)
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    books = vector_codes.fit(vectors)
    coded = vector_codes.with_label_errors(vector_codes.encode(vectors, books))
    return coded.select(
        F.col("id").alias("vec_id"), "code", "error", "label_error",
        F.sha2(F.lit(books.text() if books else ""), 256).alias("codebooks_sha256"),
    )


@query("op12_source_mix", sql.SOURCE_MIX)
def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken"
    )


@query("op13_ranked_search", sql.RANKED_SEARCH)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), best=20)
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


# ways in which transcripts name a speaker; turns of one conversation use one of them
STYLES = ("{}: ", "**{}:** ", "### {}: ", "[{}]: ", "{} >> ")


@query("op1_chat_format")
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's conversations as raw transcripts, a quarter of whose turns lack a speaker
    marker, parsed and rendered; roles are known to the model for half of them."""
    table = read(spark, sf_dir, "conversations")
    conv = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary"))
    turn = F.crc32(F.concat_ws("-", "conv_id", "turn").cast("binary"))
    style = F.element_at(F.array(*[F.lit(s) for s in STYLES]), (conv % len(STYLES) + 1).cast("int"))
    marker = F.when(turn % 4 == 0, "").otherwise(F.replace(style, F.lit("{}"), F.initcap("role")))
    role = F.array_position(F.array(*[F.lit(r) for r in chat.ROLES]), F.col("role")) - 1
    parts = table.select(
        F.col("conv_id").alias("conv"), F.col("turn").alias("part"),
        F.concat(F.coalesce(marker, F.lit("")), F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"),
        F.when((conv % 2 == 0) & (role >= 0), role).alias("known"),
    )
    return chat.parse(parts).select(
        F.col("conv").try_cast("long").alias("conv_id"), "turn", "role", "n_lines",
        F.sha2("rendered", 256).alias("rendered_sha256"), "rendered",
    )
