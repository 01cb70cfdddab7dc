"""Common ground of the iterative operators.

Nodes get a long id once, so that loops shuffle 8-byte keys instead of long
strings.  Edges lie partitioned by (source, salt) in a persisted table; a
source with very many edges is spread over several salts, and per round only
the node state moves: one row per node and salt goes to the edges, and the
messages are pre-aggregated before they travel on to their targets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.work import (
    FEW_ROWS, WorkTables, dense_index, laid_out, partitions, shuffled, small_side, tasks_of,
)

# edges of one source kept together in one (source, salt) group
EDGES_PER_SALT = 100_000


@dataclass
class Indexed:
    vertices: DataFrame  # vid, rid, repo, node_id
    pairs: DataFrame  # src, dst (vids)
    repos: DataFrame  # rid, repo, n
    n_repos: int


def index_graph(
    nodes: DataFrame, pairs: DataFrame, work: WorkTables, ordered: bool = False
) -> Indexed:
    """Number the nodes (repo, node_id) and the ends of pairs (repo, src, dst), which
    become distinct as numbers.

    ``ordered`` numbers them in id order, so that whatever is decided by a
    number does not depend on how the tables were partitioned.
    """
    node_ids = nodes.select("repo", "node_id")
    absent = (
        pairs.select("repo", F.explode(F.array("src", "dst")).alias("node_id"))
        .distinct()
        .join(shuffled(node_ids), ["repo", "node_id"], "left_anti")
    )
    every = node_ids.unionByName(absent)
    if ordered:
        listed = dense_index(every, [], ["repo", "node_id"], "vid", work)
    else:
        # fixed by writing them; nothing computes them a second time
        listed = work.keep(every.withColumn("vid", F.monotonically_increasing_id()), "listed")
    repos = work.keep(
        listed.groupBy("repo")
        .agg(F.count("*").alias("n"))
        .withColumn("rid", F.monotonically_increasing_id()),
        "repos",
    )
    n_repos = repos.count()
    vertices = listed.join(small_side(repos.select("repo", "rid"), n_repos), "repo")
    by_name = shuffled(listed.select("repo", "node_id", "vid"))
    numbered = (
        pairs.join(
            by_name.withColumnRenamed("node_id", "src").withColumnRenamed("vid", "s"),
            ["repo", "src"],
        )
        .join(
            by_name.withColumnRenamed("node_id", "dst").withColumnRenamed("vid", "d"),
            ["repo", "dst"],
        )
        .select(F.col("s").alias("src"), F.col("d").alias("dst"))
        .distinct()
    )
    return Indexed(vertices, work.keep(numbered, "pairs"), repos, n_repos)


def salted_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with ``salt``, per-source out_edges and n_salts).

    ``edges`` has src, dst and any more columns.
    """
    n = partitions(edges.sparkSession)
    sources = (
        edges.groupBy("src")
        .agg(F.count("*").alias("out_edges"))
        .withColumn("n_salts", F.ceil(F.col("out_edges") / EDGES_PER_SALT).cast("int"))
    )
    hubs = sources.filter("n_salts > 1").select("src", "n_salts")
    # at most one hub per EDGES_PER_SALT edges, so that edges nearly always stay in place
    spread = (
        edges.join(small_side(hubs, hubs.count()), "src", "left")
        .withColumn("salt", F.pmod(F.xxhash64("dst"), F.coalesce("n_salts", F.lit(1))).cast("int"))
        .drop("n_salts")
        .repartition(n, "src", "salt")
        .sortWithinPartitions("src", "salt")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    return spread, sources


def send(edges: DataFrame, state: DataFrame, *payload) -> DataFrame:
    """Rows (dst, edge columns, payload): each node's payload along its edges.
    ``state`` has vid and n_salts (null where a node has no edges).

    The edges lie sorted by (source, salt), so a merge sorts the node rows alone; they are
    never broadcast, which would send all nodes through the driver in every round."""
    outgoing = state.filter("n_salts is not null").select(
        F.col("vid").alias("src"),
        F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)).alias("salt"),
        *payload,
    )
    return edges.join(shuffled(outgoing), ["src", "salt"])


@dataclass
class Laid:
    """Edges (src, dst, w) where their sources' node rows come to lie, see ``lay``."""

    plain: DataFrame  # of all sources but hubs: partitioned and sorted by src, persisted
    parts: int
    hubs: DataFrame | None = None  # vid
    n_hubs: int = 0
    from_hubs: DataFrame | None = None

    def only(self, moving: DataFrame, rows: int) -> Laid:
        """The edges of these nodes (vid) alone; ``rows`` are the nodes and their edges."""
        own = moving.select(F.col("vid").alias("src"))
        hub_edges = self.from_hubs and self.from_hubs.join(own, "src", "left_semi")
        plain = self.plain.join(shuffled(own), "src", "left_semi")
        return _laid(plain, hub_edges, self.hubs, self.n_hubs, rows)

    def unpersist(self) -> None:
        self.plain.unpersist()


def lay(edges: DataFrame, degrees: DataFrame, n_hubs: int, rows: int) -> Laid:
    """Edges by source, ``rows`` with their nodes; ``degrees`` has src and out_edges.

    Node rows that are laid out by ``vid`` meet them in place, and so do messages laid out by
    target.  Sources of more than EDGES_PER_SALT edges, at most one per so many edges, are not
    gathered: their edges stay where they are and get the hubs' few node rows by broadcast."""
    if n_hubs == 0:
        return _laid(edges, None, None, 0, rows)
    hubs = degrees.filter(F.col("out_edges") > EDGES_PER_SALT).select("src")
    few = small_side(hubs, n_hubs)
    return _laid(
        edges.join(few, "src", "left_anti"), edges.join(few, "src", "left_semi"),
        hubs.withColumnRenamed("src", "vid"), n_hubs, rows,
    )


def _laid(plain, from_hubs, hubs, n_hubs: int, rows: int) -> Laid:
    parts = 1 if rows <= FEW_ROWS else tasks_of(plain.sparkSession, rows)
    plain = laid_out(plain, parts, "src").sortWithinPartitions("src")
    return Laid(plain.persist(StorageLevel.MEMORY_AND_DISK), parts, hubs, n_hubs, from_hubs)


def messages(laid: Laid, state: DataFrame, *payload) -> DataFrame:
    """Rows (dst, w, payload), laid out by target: the payload of each node in ``state``, whose
    rows are laid out by ``vid``, along its edges.  What goes to a hub is summed up before it
    travels.

    Nodes are never broadcast, which would send all of them through the driver."""
    outgoing = state.selectExpr("vid AS src", *payload)
    sent = laid.plain.join(shuffled(outgoing), "src").drop("src")
    if laid.hubs is not None:
        def at_hubs(rows, end, how):
            named = laid.hubs.withColumnRenamed("vid", end)
            return rows.join(small_side(named, laid.n_hubs), end, how)

        of_hubs = small_side(at_hubs(outgoing, "src", "left_semi"), laid.n_hubs)
        sent = sent.unionByName(laid.from_hubs.join(of_hubs, "src").drop("src"))
        summed = at_hubs(sent, "dst", "left_semi").groupBy(
            *[c for c in sent.columns if c != "w"]
        ).agg(F.sum("w").alias("w"))
        sent = at_hubs(sent, "dst", "left_anti").unionByName(summed)
    return laid_out(sent, laid.parts, "dst")
