"""Communities by modularity: Louvain's two phases as joins and aggregates.

All nodes look for the neighbouring community of highest gain at once; a seeded
hash of (place of the node in its repository, round) picks who may move in a round,
so that neighbours seldom swap places, and of two single nodes only the one with the
larger id joins the other.  When moving has died down, communities become the nodes
of a smaller graph, and so on while a repository's modularity still rises; a level
that does not raise it is not taken over.

Rounds of many nodes deal them and their messages out to where the edges lie.  Once few are
left, as at the later levels, one task works a round by windows, without a shuffle; both
make the same moves.

Every decision is a repository's own: when its moves have died down it rests until
the level ends, and its labels are the same alone and beside any others.  Levels end
when no repository rises any more.  A repository whose moves go on is stopped after
MAX_ROUNDS rounds, which is reported.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.work import (
    BROADCAST_ROWS, FEW_ROWS, WorkTables, dense_index, join_groups, laid_out, shuffled, small_side,
)
from . import iterate
from .graph import Graph, undirected, without_types
from .iterate import Laid, index_graph, lay, messages

MAX_ROUNDS = 64
MIN_GAIN = 1e-7
FEW_MOVERS = 0.02  # of a repository's own nodes; one node may always be left
FEW_REPOS = 1000  # named in a filter instead of joined


def modularity(memberships: DataFrame, links: DataFrame) -> DataFrame:
    """(repo, modularity) of (repo, node_id, community) over undirected links
    (repo, a, b) without weights."""
    ids = memberships.select("repo", "node_id", "community")
    ends = links
    for end in ("a", "b"):
        ends = ends.join(
            ids.withColumnRenamed("node_id", end).withColumnRenamed("community", f"c{end}"),
            ["repo", end],
        )
    inside = F.when(F.col("ca") == F.col("cb"), 1).otherwise(0)
    halves = ends.select(
        "repo",
        F.explode(
            F.array(
                F.struct(F.col("ca").alias("c"), inside.alias("inside")),
                F.struct(F.col("cb").alias("c"), F.lit(0).alias("inside")),
            )
        ).alias("h"),
    )
    per_community = halves.groupBy("repo", F.col("h.c").alias("c")).agg(
        F.count("*").alias("degree"), F.sum("h.inside").alias("inside")
    )
    per_repo = per_community.groupBy("repo").agg(
        F.sum("degree").alias("m2"),
        F.sum("inside").alias("inside"),
        F.sum(F.col("degree").cast("double") * F.col("degree")).alias("squares"),
    )
    return per_repo.select(
        "repo",
        (
            2.0 * F.col("inside") / F.col("m2") - F.col("squares") / (F.col("m2") * F.col("m2"))
        ).alias("modularity"),
    )


STATE = ("vid", "rid", "place", "links", "k", "loops", "m2", "few", "round", "comm")
SIZES = ("count(*) AS n", "coalesce(sum(links), 0L) AS n_links")
# what a node would gain in a community that a neighbour offers, and what staying is worth
GAIN = "offer_links - k * offer_tot / m2"
STAY = "coalesce(own_links, 0D) - node.k * (node.tot - node.k) / node.m2"


def _with_totals(state: DataFrame, n: int, parts: int, fresh: bool, work: WorkTables) -> DataFrame:
    """The ``n`` nodes with their community's ``tot`` and ``size``, laid out by ``vid``; while
    ``fresh`` each node is a community."""
    if parts == 1:
        return state.coalesce(1).selectExpr(
            "*", "sum(k) OVER (PARTITION BY comm) AS tot", "count(*) OVER (PARTITION BY comm) AS size"
        )
    if fresh:
        here = state.selectExpr("*", "k AS tot", "1L AS size")
    else:
        totals = state.groupBy("comm").agg(F.sum("k").alias("tot"), F.count("*").alias("size"))
        few = n <= BROADCAST_ROWS
        if not few:
            # written, since there may be as many as nodes, and joined with them in two parts
            totals = work.alternate(totals, "totals")
            few = totals.count() <= BROADCAST_ROWS
        here = (
            state.join(F.broadcast(totals), "comm") if few
            else join_groups(state, totals, "comm", "size", n)
        )
    return laid_out(here, parts, "vid")


def _move_round(
    state: DataFrame, laid: Laid, seed: int, n: int, fresh: bool, work: WorkTables
) -> DataFrame:
    """One simultaneous move of the ``n`` nodes in ``state`` (STATE columns), all of which
    have neighbours; ``wants`` says which would have moved.

    The round's number is a column, so that its code is compiled once and not in each round.
    """
    here = _with_totals(state, n, laid.parts, fresh, work)
    offers = (
        messages(laid, here, "comm AS offer", "tot AS offer_tot", "size AS offer_size")
        .groupBy("dst", "offer")
        .agg(F.expr("sum(w) AS offer_links"), F.expr("max(offer_tot) AS offer_tot"),
             F.expr("max(offer_size) AS offer_size"))
        .withColumnRenamed("dst", "vid")
    )
    # few nodes are broadcast: the optimiser would not leave this join in its one task
    met = offers.join(F.broadcast(here), "vid") if laid.parts == 1 else here.join(shuffled(offers), "vid")
    columns = ", ".join([*STATE[1:], "tot", "size"])
    return (
        met.groupBy("vid")
        .agg(
            F.expr(f"first(struct({columns})) AS node"),
            F.expr("max(CASE WHEN offer = comm THEN offer_links END) AS own_links"),
            F.expr(f"max(CASE WHEN offer <> comm THEN struct({GAIN} AS gain, -offer AS minus, "
                   "offer_size) END) AS best"),
        )
        .selectExpr(
            "vid", "node", "-best.minus AS offer",
            f"coalesce(best.gain > {STAY} + 1e-9D AND (node.size > 1 OR best.offer_size > 1 "
            "OR -best.minus < node.comm), false) AS wants",
            f"pmod(xxhash64(node.place, node.round, {seed}), 4) < 3 AS drawn",
        )
        .selectExpr(
            "vid", *[f"node.{c}" for c in STATE[1:-2]], "node.round + 1 AS round",
            "CASE WHEN wants AND drawn THEN offer ELSE node.comm END AS comm", "wants",
        )
    )


def _quality(groups: DataFrame) -> DataFrame:
    """(rid, q) from per-community loops and totals."""
    return groups.groupBy("rid").agg(
        F.sum(F.col("loops") / F.col("m2") - F.pow(F.col("k") / F.col("m2"), 2)).alias("q")
    )


def _settle(start: DataFrame, laid: Laid, seed: int, work: WorkTables, n_repos: int) -> DataFrame:
    """Rounds of moves until they have died down in each repository.

    A repository that has come to rest takes no part in later rounds, nor do its edges once
    half of the nodes are at rest; nodes without neighbours rest from the start."""
    rest = [start.filter("links = 0")]
    moving, near = start.filter("links > 0"), laid
    n, n_links = moving.selectExpr(*SIZES).first()
    n_laid = n
    try:
        for number in range(MAX_ROUNDS):
            if n == 0:
                break
            if near.parts > 1 and (2 * n <= n_laid or n + n_links <= FEW_ROWS):
                # from tables that stay: the edges may have to be laid out anew
                still = work.keep(moving.select("rid").distinct(), "near")
                own = start.join(small_side(still, n_repos), "rid", "left_semi")
                nearer = near.only(own, n + n_links)
                nearer.plain.count()  # before the edges that it is read from go
                if near is not laid:
                    near.unpersist()
                near, n_laid = nearer, n
            moved = _move_round(moving, near, seed, n, number == 0, work)
            step = _few_moved if near.parts == 1 else _moved
            moving, ended, after, n_links = step(moved, n, work, n_repos)
            if ended is not None:
                rest.append(ended)
            n = after
        if n:
            warnings.warn(f"communities: moves went on after {MAX_ROUNDS} rounds", stacklevel=2)
            rest.append(moving)
        return work.keep(reduce(DataFrame.unionByName, [r.select(*STATE) for r in rest]), "settled")
    finally:
        if near is not laid:
            near.unpersist()


def _moved(moved: DataFrame, n: int, work: WorkTables, n_repos: int):
    """A round's outcome, written: what still moves, what has come to rest if anything has,
    and how many nodes and links still move.  A repository rests if ``few`` of its nodes or
    less would move."""
    moved = work.alternate(moved, "moves")
    going = (
        moved.groupBy("rid")
        .agg(F.expr("sum(cast(wants AS bigint)) AS w"), F.expr("max(few) AS few"), *map(F.expr, SIZES))
        .filter("w > few")
    )
    if n_repos <= FEW_REPOS:
        rows = going.collect()
        after, n_links = sum(r["n"] for r in rows), sum(r["n_links"] for r in rows)
    else:
        after, n_links = going.agg(
            F.expr("coalesce(sum(n), 0L)"), F.expr("coalesce(sum(n_links), 0L)")
        ).first()
    if after == 0 or after == n:
        return moved, None if after else moved, after, n_links
    if n_repos <= FEW_REPOS:
        still = F.col("rid").isin([r["rid"] for r in rows])
        return moved.filter(still), work.keep(moved.filter(~still), "at-rest"), after, n_links
    still = small_side(work.alternate(going.select("rid"), "going"), n_repos)
    ended = work.keep(moved.join(still, "rid", "left_anti"), "at-rest")
    return moved.join(still, "rid", "left_semi"), ended, after, n_links


def _few_moved(moved: DataFrame, n: int, work: WorkTables, n_repos: int):
    """The same where one task has all rows: they are counted as they are written, once, and
    the table stays."""
    seen = Observation()
    moved = work.keep(
        moved.selectExpr(
            "*", "sum(cast(wants AS bigint)) OVER (PARTITION BY rid) > few AS going"
        ).observe(
            seen, F.expr("count_if(going) AS n"),
            F.expr("coalesce(sum(CASE WHEN going THEN links END), 0L) AS n_links"),
        ),
        "moves",
    )
    after, n_links = seen.get["n"], seen.get["n_links"]
    ended = moved.filter("NOT going") if after < n else None
    return moved.filter("going"), ended, after, n_links


def _contracted(state: DataFrame, laid: Laid, work: WorkTables) -> DataFrame:
    """(csrc, cdst, w): links between communities, and inside them."""
    here = laid_out(state.select("vid", "comm"), laid.parts, "vid")
    to = here.selectExpr("vid AS dst", "comm AS cdst")
    return work.keep(
        messages(laid, here, "comm AS csrc")
        .join(shuffled(to), "dst")
        .groupBy("csrc", "cdst").agg(F.sum("w").alias("w")),
        "between",
    )


def detect(graph: Graph, seed: int = fixed.COMMUNITY_SEED, work: WorkTables | None = None):
    """(repo, node_id, comm) for every eligible node; ``comm`` is an arbitrary id."""
    work = (work or WorkTables(graph.nodes.sparkSession)).child()
    eligible = without_types(graph, fixed.COMMUNITY_SKIP_TYPES)
    links = work.keep(
        undirected(eligible.edges).select("repo", F.col("a").alias("src"), F.col("b").alias("dst")),
        "links",
    )
    indexed = index_graph(eligible.nodes, links, work, ordered=True)
    edges = indexed.pairs.select(
        F.explode(F.array(F.struct("src", "dst"), F.struct(
            F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    ).select("e.src", "e.dst", F.lit(1.0).alias("w"))
    nodes = indexed.vertices.select("vid", "rid", F.lit(0.0).alias("loops"))
    bases = work.keep(nodes.groupBy("rid").agg(F.min("vid").alias("base")), "bases")

    members = indexed.vertices.select("vid", F.col("vid").alias("comm"))
    best = None
    while True:
        degrees = work.keep(
            edges.groupBy("src").agg(F.sum("w").alias("linked"), F.count("*").alias("out_edges")),
            "degrees",
        )
        n_edges, n_hubs = degrees.agg(
            F.coalesce(F.sum("out_edges"), F.lit(0)), F.count_if(F.col("out_edges") > iterate.EDGES_PER_SALT)
        ).first()
        sized = nodes.join(
            shuffled(degrees.withColumnRenamed("src", "vid")), "vid", "left"
        ).withColumn("k", F.coalesce("linked", F.lit(0.0)) + F.col("loops"))
        repos = (
            sized.groupBy("rid")
            .agg(F.sum("k").alias("m2"), F.greatest(F.lit(1.0), F.count("*") * FEW_MOVERS).alias("few"))
            .filter("m2 > 0")
            .join(bases, "rid")
        )
        start = work.keep(
            sized.join(small_side(repos, indexed.n_repos), "rid").select(
                "vid", "rid", (F.col("vid") - F.col("base")).alias("place"),
                F.coalesce("out_edges", F.lit(0)).alias("links"), "k", "loops", "m2", "few",
                F.lit(0).alias("round"), F.col("vid").alias("comm"),
            ),
            "level",
        )
        if best is None:
            best = work.alternate(_quality(start), "quality")
        laid = lay(edges, degrees, n_hubs, start.count() + n_edges)
        try:
            state = _settle(start, laid, seed, work, indexed.n_repos)
            between = _contracted(state, laid, work)
        finally:
            laid.unpersist()

        inner = between.filter("csrc = cdst").select(
            F.col("csrc").alias("vid"), F.col("w").alias("inner")
        )
        groups = (
            state.groupBy(F.col("comm").alias("vid"), "rid", "m2")
            .agg(F.sum("k").alias("k"), F.sum("loops").alias("loops"))
            .join(inner, "vid", "left")
            .withColumn("loops", F.col("loops") + F.coalesce("inner", F.lit(0.0)))
            .select("vid", "rid", "k", "loops", "m2")
        )
        groups = work.keep(groups, "groups")
        risen = work.keep(
            _quality(groups)
            .withColumnRenamed("q", "q_new")
            .join(best, "rid")
            .filter(F.col("q_new") > F.col("q") + MIN_GAIN)
            .select("rid", F.col("q_new").alias("q")),
            "risen",
        )
        n_risen = risen.count()
        if n_risen == 0:
            break
        taken = state.join(small_side(risen.select("rid"), n_risen), "rid", "left_semi").select(
            F.col("vid").alias("comm"), F.col("comm").alias("parent")
        )
        members = work.alternate(
            members.join(taken, "comm", "left").select(
                "vid", F.coalesce("parent", "comm").alias("comm")
            ),
            "members",
        )
        best = risen
        nodes = groups.join(small_side(risen.select("rid"), n_risen), "rid", "left_semi").select(
            "vid", "rid", "loops"
        )
        edges = (
            between.filter("csrc <> cdst")
            .join(nodes.select(F.col("vid").alias("csrc")), "csrc", "left_semi")
            .select(F.col("csrc").alias("src"), F.col("cdst").alias("dst"), "w")
        )
    return indexed.vertices.join(members, "vid").select("repo", "node_id", "comm")


def communities(
    graph: Graph, seed: int = fixed.COMMUNITY_SEED, work: WorkTables | None = None
) -> DataFrame:
    """(repo, node_id, community): 0-based per repository, in the order of each
    community's smallest member; -1 for nodes left out of detection."""
    work = work or WorkTables(graph.nodes.sparkSession)
    found = detect(graph, seed, work)
    heads = found.groupBy("repo", "comm").agg(F.min("node_id").alias("head"))
    numbered = dense_index(heads, ["repo"], ["head"], "community", work)
    labelled = found.join(numbered.select("repo", "comm", "community"), ["repo", "comm"])
    return work.keep(
        graph.nodes.select("repo", "node_id")
        .join(labelled.select("repo", "node_id", "community"), ["repo", "node_id"], "left")
        .select(
            "repo",
            "node_id",
            F.coalesce("community", F.lit(-1)).cast("int").alias("community"),
        ),
        "communities",
    )


def with_communities(graph: Graph, labels: DataFrame) -> Graph:
    nodes = graph.nodes.join(labels, ["repo", "node_id"], "left").withColumn(
        "community", F.coalesce("community", F.lit(-1))
    )
    return Graph(nodes, graph.edges, graph.n_edges)
