"""PageRank per repository over distinct ordered pairs.

Uniform start, unit weights, the mass of nodes without successors spread evenly
over their repository.  A repository is done when the summed change of a round
falls below its node count times the tolerance; it is then frozen while others
go on.  One that has not settled after the last round gets rank 1.0 throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.work import WorkTables, small_side
from .graph import Graph
from .iterate import index_graph, salted_edges, send

# rounds between two looks at whether any repository still moves
ROUNDS_PER_LOOK = 5


def pagerank(
    graph: Graph,
    alpha: float = fixed.PAGERANK_ALPHA,
    tolerance: float = fixed.PAGERANK_TOLERANCE,
    max_rounds: int = fixed.PAGERANK_MAX_ROUNDS,
    rounds: int | None = None,
    work: WorkTables | None = None,
) -> DataFrame:
    """(repo, node_id, rank).  ``rounds`` runs that many rounds whatever the
    change; otherwise repositories stop one by one."""
    work = (work or WorkTables(graph.nodes.sparkSession)).child()
    indexed = index_graph(graph.nodes, graph.edges, work)
    edges, sources = salted_edges(indexed.pairs)
    sizes = indexed.repos.select("rid", "n")

    state = work.alternate(
        indexed.vertices.select("vid", "rid")
        .join(sources.withColumnRenamed("src", "vid"), "vid", "left")
        .join(small_side(sizes, indexed.n_repos), "rid")
        .select(
            "vid",
            "rid",
            "out_edges",
            "n_salts",
            (F.lit(1.0) / F.col("n")).alias("rank"),
            F.lit(float("inf")).alias("change"),
        ),
        "ranks",
    )

    def per_repo(state: DataFrame) -> DataFrame:
        """(rid, n, idle, active): mass without successors, and whether the last
        change was too large to stop."""
        idle = F.when(F.col("out_edges").isNull(), F.col("rank")).otherwise(0.0)
        moving = F.lit(True) if rounds is not None else (
            F.col("change") >= F.col("n") * tolerance
        )
        return (
            state.groupBy("rid")
            .agg(F.sum(idle).alias("idle"), F.sum("change").alias("change"))
            .join(sizes, "rid")
            .select("rid", "n", "idle", moving.alias("active"))
        )

    limit = max_rounds if rounds is None else rounds
    try:
        for done in range(1, limit + 1):
            current = state.join(small_side(per_repo(state), indexed.n_repos), "rid")
            received = (
                send(
                    edges,
                    current.filter("active"),
                    (F.col("rank") / F.col("out_edges")).alias("share"),
                )
                .groupBy(F.col("dst").alias("vid"))
                .agg(F.sum("share").alias("received"))
            )
            fresh = alpha * F.coalesce("received", F.lit(0.0)) + (
                alpha * F.col("idle") + (1.0 - alpha)
            ) / F.col("n")
            state = work.alternate(
                current.join(received, "vid", "left")
                .withColumn("fresh", F.when(F.col("active"), fresh).otherwise(F.col("rank")))
                .select(
                    "vid",
                    "rid",
                    "out_edges",
                    "n_salts",
                    F.col("fresh").alias("rank"),
                    F.abs(F.col("fresh") - F.col("rank")).alias("change"),
                ),
                "ranks",
            )
            # a frozen repository does not change, so looking now and then is exact
            if rounds is None and done % ROUNDS_PER_LOOK == 0:
                if per_repo(state).filter("active").isEmpty():
                    break
    finally:
        edges.unpersist()
    totals = per_repo(state)

    final = state.join(small_side(totals.select("rid", "active"), indexed.n_repos), "rid")
    unsettled = F.col("active") if rounds is None else F.lit(False)
    return indexed.vertices.join(
        final.select("vid", F.when(unsettled, 1.0).otherwise(F.col("rank")).alias("rank")),
        "vid",
    ).select("repo", "node_id", "rank")
