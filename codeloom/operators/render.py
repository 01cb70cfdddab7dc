"""Markdown pages as table rows: one per internal node, one index per project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.names import capitalise, page_name, symbol_of, wiki_link
from .graph import Graph
from .metrics import capped_neighbours, incoming, internal_sources, outgoing

HEADINGS = {"out": "## → Outgoing", "in": "## ← Incoming"}
PEERS_HEADING = "## 🏘️ Same Module (Community)"
INDEX_HEADING = "\n## 🔥 Top God Nodes"
NODE_KEY = ["repo", "node_id"]


def _bullets(ids: Column) -> Column:
    return F.transform(ids, lambda n: F.concat(F.lit("- "), wiki_link(n)))


def _lines(*parts: Column) -> Column:
    return F.array_join(F.concat(*parts), "\n")


def pages_wanted(nodes: DataFrame, mode: str) -> DataFrame:
    """Internal nodes; classic mode also leaves out symbols shorter than 2
    characters or with a leading underscore."""
    wanted = nodes.filter(~F.coalesce("external", F.lit(False)))
    if mode == "classic":
        symbol = symbol_of(F.col("node_id"))
        hidden = (F.length(symbol) < 2) | F.startswith(symbol, F.lit("_"))
        wanted = wanted.filter(symbol.isNull() | ~hidden)
    return wanted


def page_winners(nodes: DataFrame) -> DataFrame:
    """Of nodes whose ids clean to the same page name, the last one by ``seq`` and id.
    Settled on names alone, before any page body exists."""
    return (
        nodes.select("repo", "node_id", "seq", page_name(F.col("node_id")).alias("page"))
        .groupBy("repo", "page")
        .agg(F.max_by("node_id", F.struct("seq", "node_id")).alias("node_id"))
    )


def sections(graph: Graph) -> DataFrame:
    """(repo, node_id, out_lines, in_lines): the two neighbour sections."""
    both = outgoing(graph.edges).unionByName(
        incoming(internal_sources(graph.edges, graph.nodes))
    )
    rows = None if graph.n_edges is None else 2 * graph.n_edges
    lists = capped_neighbours(both, fixed.PAGE_NEIGHBOURS, rows)
    block = F.struct(
        "type",
        F.concat(
            F.array(F.concat(F.lit("**"), capitalise(F.col("type")), F.lit(":**"))),
            _bullets(F.col("neighbours")),
        ).alias("lines"),
    )

    def gathered(direction: str) -> Column:
        blocks = F.array_sort(
            F.collect_list(F.when(F.col("direction") == direction, block))
        )
        lines = F.flatten(F.transform(blocks, lambda b: b["lines"]))
        return F.when(
            F.size(blocks) > 0,
            F.concat(F.array(F.lit(HEADINGS[direction])), lines, F.array(F.lit(""))),
        )

    return lists.groupBy(*NODE_KEY).agg(
        gathered("out").alias("out_lines"), gathered("in").alias("in_lines")
    )


def peers(nodes: DataFrame, cap: int = fixed.PAGE_PEERS) -> DataFrame:
    """(repo, community, first): the first ``cap`` + 1 internal members, enough
    for every member to see ``cap`` others."""
    ordered = W.partitionBy("repo", "community").orderBy("node_id")
    return (
        nodes.filter((F.col("community") != -1) & ~F.coalesce("external", F.lit(False)))
        .select("repo", "community", "node_id")
        .withColumn("_rank", F.row_number().over(ordered))
        .filter(F.col("_rank") <= cap + 1)
        .groupBy("repo", "community")
        .agg(F.array_sort(F.collect_list("node_id")).alias("first"))
    )


def node_pages(graph: Graph, mode: str = "classic") -> DataFrame:
    """(repo, mode, page, node_id, body).  Nodes carry ``seq`` and may carry
    ``community``."""
    nodes = graph.nodes
    if "community" not in nodes.columns:
        nodes = nodes.withColumn("community", F.lit(-1))
    nodes = nodes.withColumn("community", F.coalesce("community", F.lit(-1)))
    wanted = pages_wanted(nodes, mode)
    shown = wanted.select("repo", "node_id", "node_type", "community").join(
        page_winners(wanted), NODE_KEY
    )
    rows = shown.join(sections(graph), NODE_KEY, "left")
    if mode == "smart":
        rows = rows.join(peers(nodes), ["repo", "community"], "left")
        others = F.slice(
            F.filter("first", lambda p: p != F.col("node_id")), 1, fixed.PAGE_PEERS
        )
        peer_lines = F.when(
            F.size(others) > 0,
            F.concat(F.array(F.lit(PEERS_HEADING)), _bullets(others), F.array(F.lit(""))),
        )
    else:
        peer_lines = F.lit(None).cast("array<string>")
    none = F.array().cast("array<string>")
    node_type = F.coalesce("node_type", F.lit("unknown"))
    head = F.array(
        F.concat(F.lit("# "), F.col("node_id")),
        F.lit(""),
        F.concat(F.lit("type:: "), F.replace(node_type, F.lit(" "), F.lit("_"))),
    )
    community = F.when(
        F.col("community") != -1,
        F.array(F.concat(F.lit("community:: "), F.col("community").cast("string"))),
    )
    body = _lines(
        head,
        F.coalesce(community, none),
        F.array(F.lit("")),
        F.coalesce("out_lines", none),
        F.coalesce("in_lines", none),
        F.coalesce(peer_lines, none),
    )
    return rows.select("repo", F.lit(mode).alias("mode"), "page", "node_id", body.alias("body"))


def index_pages(metadata: DataFrame) -> DataFrame:
    """(repo, mode, page, body) from metadata rows: project, mode, total_nodes,
    scan_date, god_nodes."""
    gods = F.slice(F.col("god_nodes.internal"), 1, fixed.INDEX_GOD_NODES)
    bullets = F.transform(
        gods,
        lambda g: F.concat(
            F.lit("- "),
            wiki_link(g["node"]),
            F.lit(" ("),
            g["degree"].cast("string"),
            F.lit(" connections)"),
        ),
    )
    title = F.concat(
        F.lit("# "), F.col("project"), F.lit(" Architecture ("), F.initcap("mode"), F.lit(" Mode)")
    )
    counts = F.concat(
        F.lit("Nodes: "),
        F.format_number(F.col("total_nodes"), 0),
        F.lit(" | Generated: "),
        F.coalesce("scan_date", F.lit("N/A")),
    )
    body = _lines(
        F.array(title, F.lit(""), counts, F.lit(INDEX_HEADING)),
        F.coalesce(bullets, F.array().cast("array<string>")),
    )
    return metadata.select(
        F.col("project").alias("repo"), "mode", F.lit("INDEX").alias("page"), body.alias("body")
    )
