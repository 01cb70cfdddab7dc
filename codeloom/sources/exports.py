"""Graph exports and pages on disk.

An export is three tables (nodes, edges, metadata) below one folder, each
partitioned by mode and clustered by repository.  Documents that hold one whole
graph as nested JSON can be read; they are not written, since a graph would
have to fit into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import decoded_path
from ..operators.graph import SEQ_TYPE, Graph

GOD_LIST = "array<struct<node:string,degree:bigint>>"
METADATA_SCHEMA = (
    "project string, mode string, total_nodes bigint, total_edges bigint, "
    "generated_by string, scan_date string, communities_count bigint, "
    f"god_nodes struct<internal: {GOD_LIST}, external: {GOD_LIST}>, "
    "parser_info map<string,struct<files:bigint,method:string>>"
)
DOCUMENT_SCHEMA = (
    "nodes array<struct<id:string,type:string,community:int,external:boolean>>, "
    "edges array<struct<source:string,target:string,type:string>>, "
    f"metadata struct<{METADATA_SCHEMA}>"
)


def read_documents(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """Graph documents, one JSON object per file -> (graph, metadata).

    Missing keys take the defaults of the format; a document without a project
    name is named by its file.
    """
    raw = (
        spark.read.schema(DOCUMENT_SCHEMA)
        .option("multiLine", True)
        .json(path)
        .withColumn("path", decoded_path(F.input_file_name()))
    )
    stem = F.regexp_replace(
        F.substring_index("path", "/", -1),
        r"\.[^.]*$|_mapping_v10|_mapping_classic|_mapping_smart",
        "",
    )
    docs = raw.withColumn("repo", F.coalesce("metadata.project", stem))
    node = docs.select("repo", F.posexplode("nodes").alias("at", "n"))
    last = (
        node.filter("n.id is not null")
        .groupBy("repo", F.col("n.id").alias("node_id"))
        .agg(
            F.max_by("n", "at").alias("n"),
            F.min("at").alias("at"),
        )
    )
    nodes = last.select(
        "repo",
        "node_id",
        F.coalesce("n.type", F.lit("unknown")).alias("node_type"),
        F.coalesce("n.external", F.lit(False)).alias("external"),
        F.coalesce("n.community", F.lit(-1)).alias("community"),
        F.struct(
            F.lit(0).alias("class"),
            F.lit(0).cast("bigint").alias("file"),
            F.lit(0).alias("stage"),
            F.col("at").cast("bigint").alias("pos"),
        ).alias("seq"),
    )
    edges = docs.select("repo", F.explode("edges").alias("e")).select(
        "repo",
        F.col("e.source").alias("src"),
        F.col("e.target").alias("dst"),
        F.coalesce("e.type", F.lit("related")).alias("type"),
    )
    counted = F.coalesce(F.size(F.array_distinct(F.transform("nodes", lambda n: n["id"]))), F.lit(0))
    metadata = docs.select(
        F.col("repo").alias("project"),
        F.coalesce("metadata.mode", F.lit("classic")).alias("mode"),
        counted.cast("bigint").alias("total_nodes"),
        F.coalesce("metadata.scan_date", F.lit("N/A")).alias("scan_date"),
        "metadata.god_nodes",
    )
    return Graph(nodes, edges), metadata


def write_export(
    views: dict[str, Graph], metadata: DataFrame, path: str, fmt: str = "parquet"
) -> None:
    """Each mode's nodes and edges and the metadata rows.

    Range clustering keeps a repository together yet spreads a large one over
    as many files as it needs; a folder per repository would drown the name
    node in small files.
    """
    for mode, graph in views.items():
        columns = [F.col("repo"), F.col("node_id").alias("id"), F.col("node_type").alias("type")]
        if "community" in graph.nodes.columns:
            columns.append("community")
        nodes = graph.nodes.select(*columns, "external", "seq")
        edges = graph.edges.select(
            "repo", F.col("src").alias("source"), F.col("dst").alias("target"), "type"
        )
        for name, table, order in (
            ("nodes", nodes, ["repo", "id"]),
            ("edges", edges, ["repo", "source", "target"]),
        ):
            table.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(
                "overwrite"
            ).format(fmt).save(f"{path}/{name}/mode={mode}")
    metadata.write.mode("overwrite").partitionBy("mode").format(fmt).save(f"{path}/metadata")


def read_export(
    spark: SparkSession, path: str, mode: str, fmt: str = "parquet"
) -> tuple[Graph, DataFrame]:
    """An export written by ``write_export``; the mode prunes the other's files."""
    nodes = (
        spark.read.format(fmt)
        .schema(
            "repo string, id string, type string, community int, external boolean, "
            f"seq {SEQ_TYPE}, mode string"
        )
        .load(f"{path}/nodes")
        .filter(F.col("mode") == mode)
        .select(
            "repo",
            F.col("id").alias("node_id"),
            F.coalesce("type", F.lit("unknown")).alias("node_type"),
            F.coalesce("external", F.lit(False)).alias("external"),
            F.coalesce("community", F.lit(-1)).alias("community"),
            "seq",
        )
    )
    edges = (
        spark.read.format(fmt)
        .schema("repo string, source string, target string, type string, mode string")
        .load(f"{path}/edges")
        .filter(F.col("mode") == mode)
        .select(
            "repo",
            F.col("source").alias("src"),
            F.col("target").alias("dst"),
            F.coalesce("type", F.lit("related")).alias("type"),
        )
    )
    metadata = (
        spark.read.format(fmt)
        .schema(METADATA_SCHEMA)
        .load(f"{path}/metadata")
        .filter(F.col("mode") == mode)
    )
    return Graph(nodes, edges), metadata


def write_pages(pages: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Pages as a table partitioned by mode, clustered by repository and page."""
    (
        pages.repartitionByRange("mode", "repo", "page")
        .write.mode("overwrite")
        .partitionBy("mode")
        .format(fmt)
        .save(path)
    )
