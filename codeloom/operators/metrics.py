"""Degrees, top lists, neighbour lists and summaries of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.work import ROWS_PER_TASK, dealt, shuffled
from .graph import Graph, pairs_of


def degrees(graph: Graph) -> DataFrame:
    """(repo, node_id, degree): in + out over distinct ordered pairs; nodes
    without edges have 0, edge ends that are no node count as nodes."""
    ends = pairs_of(graph).select(
        "repo", F.explode(F.array("src", "dst")).alias("node_id"), F.lit(1).alias("n")
    )
    lone = graph.nodes.select("repo", "node_id", F.lit(0).alias("n"))
    return (
        ends.unionByName(lone)
        .groupBy("repo", "node_id")
        .agg(F.sum("n").cast("bigint").alias("degree"))
    )


def degrees_with_nodes(graph: Graph) -> DataFrame:
    """Degrees with each node's type and origin, in one aggregation."""
    ends = pairs_of(graph).select(
        "repo",
        F.explode(F.array("src", "dst")).alias("node_id"),
        F.lit(1).alias("n"),
        F.lit(None).cast("string").alias("node_type"),
        F.lit(None).cast("boolean").alias("external"),
    )
    nodes = graph.nodes.select(
        "repo", "node_id", F.lit(0).alias("n"), "node_type", "external"
    )
    counted = ends.groupBy("repo", "node_id").agg(F.sum("n").cast("bigint").alias("degree"))
    return (
        nodes.join(dealt(counted, graph.n_edges, "repo", "node_id"), ["repo", "node_id"], "full_outer")
        .select(
            "repo",
            "node_id",
            F.coalesce("degree", F.lit(0).cast("bigint")).alias("degree"),
            "node_type",
            F.coalesce("external", F.lit(False)).alias("external"),
        )
    )


def god_nodes(graph: Graph, top: int = fixed.DEFAULT_GOD_NODES) -> DataFrame:
    """(repo, external, rank, node_id, degree): the best connected nodes of each
    repository, folders left out, internal and external apart.

    The ranking filter is a window group limit: each task keeps its own best
    ``top`` before the shuffle, so a repository of any size sends few rows.
    """
    ranked = W.partitionBy("repo", "external").orderBy(F.desc("degree"), "node_id")
    return (
        degrees_with_nodes(graph)
        .filter("node_type is null or node_type <> 'folder'")
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= top)
        .select("repo", "external", F.col("rank").cast("bigint").alias("rank"),
                "node_id", "degree")
    )


def extract_stats(files: DataFrame, methods: dict[str, str]) -> DataFrame:
    """(repo, ext, files, method): files per extension, the dot left off."""
    label = F.create_map(*[F.lit(x) for pair in methods.items() for x in pair])
    return (
        files.groupBy("repo", "ext")
        .agg(F.count("*").alias("files"))
        .select(
            "repo",
            F.ltrim(F.col("ext"), F.lit(".")).alias("ext"),
            "files",
            F.coalesce(F.get(F.array(label[F.col("ext")]), F.lit(0)), F.lit("unknown")).alias(
                "method"
            ),
        )
    )


def adjacency(edges: DataFrame) -> DataFrame:
    """(repo, node_id, direction, type, neighbour), both directions, as rows: the
    list of a hub is as long as the graph and is never gathered into one cell."""
    row = F.explode(
        F.array(
            F.struct(
                F.col("src").alias("node_id"),
                F.lit("out").alias("direction"),
                F.col("dst").alias("neighbour"),
            ),
            F.struct(
                F.col("dst").alias("node_id"),
                F.lit("in").alias("direction"),
                F.col("src").alias("neighbour"),
            ),
        )
    ).alias("e")
    return edges.select("repo", "type", row).select(
        "repo", "e.node_id", "e.direction", "type", "e.neighbour"
    )


def outgoing(edges: DataFrame) -> DataFrame:
    """``adjacency`` of the sources alone."""
    return edges.select(
        "repo", F.col("src").alias("node_id"), F.lit("out").alias("direction"), "type",
        F.col("dst").alias("neighbour"),
    )


def incoming(edges: DataFrame) -> DataFrame:
    """``adjacency`` of the targets alone."""
    return edges.select(
        "repo", F.col("dst").alias("node_id"), F.lit("in").alias("direction"), "type",
        F.col("src").alias("neighbour"),
    )


def internal_sources(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose source is not an external node (an absent source counts as
    internal)."""
    outside = nodes.filter("external").select("repo", F.col("node_id").alias("src"))
    return edges.join(shuffled(outside), ["repo", "src"], "left_anti")


NEIGHBOUR_KEYS = ("repo", "node_id", "direction", "type")
# a list with so many rows in a sample of one row in SAMPLED is that of a hub
SAMPLED, HUB_IN_SAMPLE = 200, 100


def capped_neighbours(
    neighbours: DataFrame, cap: int = fixed.PAGE_NEIGHBOURS, rows: int | None = None
) -> DataFrame:
    """(repo, node_id, direction, type, neighbours): the first ``cap`` distinct
    neighbours in code-point order.

    Rows past the cap are cut in each task before the shuffle.  Where ``rows``, how many
    there are at most, exceeds one task's, only the lists of hubs, found in a sample, are;
    there is nothing to cut in the others, which are dealt out and sorted once."""

    def first(listed: DataFrame) -> DataFrame:
        # sorting compares one number, names only where it is equal
        ordered = W.partitionBy("_list", *NEIGHBOUR_KEYS).orderBy("neighbour")
        whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        return (
            listed.withColumn("_list", number).withColumn("_rank", F.dense_rank().over(ordered))
            .filter(F.col("_rank") <= cap)
            .withColumn("neighbours", F.collect_list("neighbour").over(whole))
            .withColumn("_at", F.row_number().over(ordered))
            .filter("_at = 1")
            .select(*NEIGHBOUR_KEYS, F.array_distinct("neighbours").alias("neighbours"))
        )

    number = F.xxhash64(*NEIGHBOUR_KEYS)
    if rows is None or rows <= ROWS_PER_TASK:
        return first(neighbours)
    listed = neighbours.select(*NEIGHBOUR_KEYS, "neighbour", number.alias("_list"))
    hubs = F.broadcast(
        listed.sample(1 / SAMPLED, seed=0).groupBy("_list").agg(F.count("*").alias("_n"))
        .filter(F.col("_n") >= HUB_IN_SAMPLE).select("_list")
    )
    light = dealt(listed.join(hubs, "_list", "left_anti").drop("_list"), rows, *NEIGHBOUR_KEYS)
    return first(light).unionByName(first(listed.join(hubs, "_list", "left_semi")))


def community_members(nodes: DataFrame) -> DataFrame:
    """(repo, community, node_id) of nodes in a community, as rows."""
    return nodes.filter("community <> -1").select("repo", "community", "node_id")


def community_counts(nodes: DataFrame) -> DataFrame:
    return (
        nodes.filter("community <> -1")
        .groupBy("repo")
        .agg(F.countDistinct("community").alias("communities_count"))
    )


def top_lists(graph: Graph, top: int) -> DataFrame:
    """(repo, internal, external): arrays of (node, degree), at most ``top`` long."""
    item = F.struct("rank", F.col("node_id").alias("node"), "degree")
    gods = god_nodes(graph, top).groupBy("repo").agg(
        F.array_sort(F.collect_list(F.when(~F.col("external"), item))).alias("internal"),
        F.array_sort(F.collect_list(F.when(F.col("external"), item))).alias("external"),
    )

    def bare(items):
        return F.transform(
            items, lambda g: F.struct(g["node"].alias("node"), g["degree"].alias("degree"))
        )

    return gods.select(
        "repo",
        F.struct(bare("internal").alias("internal"), bare("external").alias("external")).alias(
            "god_nodes"
        ),
    )


def graph_metadata(
    classic: Graph,
    views: dict[str, Graph],
    stats: DataFrame,
    top: int = fixed.DEFAULT_GOD_NODES,
    scan_date=None,
) -> DataFrame:
    """One row per repository and mode: totals of that mode's view, communities
    and top lists of the whole graph, and extraction statistics."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    # every repository gets a row in every mode, also where nothing is left
    rows = [
        classic.nodes.select("repo").distinct().select(
            "repo", F.lit(mode).alias("mode"), none.alias("n"), none.alias("e")
        )
        for mode in views
    ]
    for mode, view in views.items():
        label = F.lit(mode).alias("mode")
        rows.append(view.nodes.select("repo", label, one.alias("n"), none.alias("e")))
        rows.append(view.edges.select("repo", label, none.alias("n"), one.alias("e")))
    totals = (
        reduce(DataFrame.unionByName, rows)
        .groupBy("repo", "mode")
        .agg(F.sum("n").alias("total_nodes"), F.sum("e").alias("total_edges"))
    )
    info = stats.groupBy("repo").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("ext", F.struct("files", "method"))))
        ).alias("parser_info")
    )
    out = totals.join(top_lists(classic, top), "repo", "left").join(info, "repo", "left")
    if "community" in classic.nodes.columns:
        out = out.join(community_counts(classic.nodes), "repo", "left")
    else:
        out = out.withColumn("communities_count", F.lit(0).cast("bigint"))
    date = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return out.select(
        F.col("repo").alias("project"),
        "mode",
        "total_nodes",
        "total_edges",
        F.lit("codeloom").alias("generated_by"),
        (date if scan_date is None else F.lit(scan_date)).alias("scan_date"),
        F.coalesce("communities_count", F.lit(0).cast("bigint")).alias("communities_count"),
        "god_nodes",
        "parser_info",
    )
