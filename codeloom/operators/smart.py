"""The filtered graph: drop noise, reconnect what stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.names import symbol_of
from ..functions.work import WorkTables, shuffled
from .graph import EDGE_COLUMNS, Graph


def is_kept():
    """Over columns node_id, node_type, external, rank."""
    symbol = symbol_of(F.col("node_id"))
    important = F.col("node_type").isin(*fixed.IMPORTANT_TYPES)
    rank = F.coalesce("rank", F.lit(0.0))
    noise = (
        (F.length(symbol) < 3)
        | F.startswith(symbol, F.lit("_"))
        | F.startswith(F.lower(symbol), F.lit("test"))
        | F.lower(symbol).isin(*fixed.NOISE_SYMBOLS)
    )
    central = F.when(important, rank > fixed.MIN_RANK_IMPORTANT).otherwise(
        rank > fixed.MIN_RANK_OTHER
    )
    return ~F.coalesce("external", F.lit(False)) & F.when(
        symbol.isNull(), important | (F.col("node_type") == "folder")
    ).otherwise(~noise & central)


def smart_nodes(nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    """The nodes that stay, with all their columns."""
    return (
        nodes.join(
            shuffled(ranks.select("repo", "node_id", "rank")), ["repo", "node_id"], "left"
        )
        .filter(is_kept())
        .select(*nodes.columns)
    )


def smart_edges(
    edges: DataFrame, kept: DataFrame, work: WorkTables | None = None
) -> DataFrame:
    """Edges between kept nodes, and one-hop detours through dropped ones.

    Where a dropped node lies between two kept ones, the edge into it and the
    edge out of it each give an edge from end to end, with their own type.
    With ``work`` the edges are marked once and written; else each of the three
    uses marks them anew.
    """
    ids = kept.select("repo", "node_id", F.lit(True).alias("in"))
    flagged = edges.select(*EDGE_COLUMNS)
    for end, flag in (("src", "src_in"), ("dst", "dst_in")):
        flagged = flagged.join(
            shuffled(ids.withColumnRenamed("node_id", end).withColumnRenamed("in", flag)),
            ["repo", end],
            "left",
        )
    flagged = flagged.filter("src_in is not null or dst_in is not null")
    if work is not None:
        flagged = work.keep(flagged, "marked-edges")
    src_in, dst_in = F.col("src_in").isNotNull(), F.col("dst_in").isNotNull()
    direct = flagged.filter(src_in & dst_in).select(*EDGE_COLUMNS)
    into = flagged.filter(src_in & ~dst_in).select(
        "repo", "src", F.col("dst").alias("mid"), F.col("type").alias("type_in")
    )
    out_of = flagged.filter(~src_in & dst_in).select(
        "repo", F.col("src").alias("mid"), "dst", F.col("type").alias("type_out")
    )
    detours = into.join(out_of, ["repo", "mid"]).select(
        "repo", "src", "dst", F.explode(F.array_distinct(F.array("type_in", "type_out"))).alias("type")
    )
    return direct.unionByName(detours).distinct()


def smart_graph(graph: Graph, ranks: DataFrame, work: WorkTables | None = None) -> Graph:
    kept = smart_nodes(graph.nodes, ranks)
    if work is not None:
        kept = work.keep(kept, "kept-nodes")
    return Graph(kept, smart_edges(graph.edges, kept, work))
