"""Keyword index and phrase search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import keywords, phrase_words
from ..functions.work import WorkTables, dense_index
from .graph import Graph
from .metrics import degrees


def keyword_index(nodes: DataFrame) -> DataFrame:
    """(repo, word, node_id): the words of each id and its type, length over 2."""
    return nodes.select(
        "repo", F.explode(keywords(F.col("node_id"), F.col("node_type"))).alias("word"), "node_id"
    )


def _words_hit(nodes: DataFrame, index: DataFrame, terms: DataFrame) -> DataFrame:
    """(set_id, repo, number, degree, words_hit) of nodes (set_id, repo, number, degree)."""
    return (
        nodes.join(index.select("number", "word"), "number")
        .join(terms.select("set_id", "repo", "word"), ["set_id", "repo", "word"])
        .groupBy("set_id", "repo", "number", "degree").agg(F.count("*").alias("words_hit"))
    )


def keyword_search(
    queries: DataFrame, graph: Graph, top: int = 10, work: WorkTables | None = None
) -> DataFrame:
    """(query_id, repo, rank, node_id, words_hit, degree) for a table of queries
    (query_id, repo, phrase); a null repo asks all of them.

    Ranked by words hit, then degree, then id, within each query and repository.
    Equal sets of words are scored once.  The nodes of a set's rarest word and those of
    highest degree of each of its words are scored first, which gives a bound that a node
    must reach.  Of the other words a node is then looked at only where it can reach it: with
    the words in order of how few nodes have them, a node whose first word is the j-th of k
    hits k - j + 1 at most, so frequent words are left alone, and the first one that could
    just do is read down to the bound's degree.
    """
    work = work or WorkTables(graph.nodes.sparkSession)
    asked = queries.select(
        "query_id", F.col("repo").alias("_asked"),
        F.array_sort(phrase_words(F.col("phrase"))).alias("words"),
    ).filter(F.size("words") > 0)
    sets = work.keep(
        asked.select("_asked", "words").distinct()
        .withColumn("set_id", F.monotonically_increasing_id()),
        "word-sets",
    )
    described = graph.nodes.select("repo", "node_id", "node_type").join(
        degrees(graph), ["repo", "node_id"]
    )
    numbered = dense_index(described, [], ["repo", "node_id"], "number", work)
    index = work.keep(
        numbered.select(
            "repo", "number", "degree",
            F.explode(keywords(F.col("node_id"), F.col("node_type"))).alias("word"),
        ),
        "postings",
    )
    terms = sets.select("set_id", F.col("_asked").alias("repo"), F.explode("words").alias("word"))
    counts = work.keep(index.groupBy("repo", "word").agg(F.count("*").alias("nodes")), "counts")
    # a query about one repository meets only that repository's words
    local = counts.join(terms.filter("repo is not null"), ["repo", "word"])
    anywhere = counts.join(terms.filter("repo is null").drop("repo"), "word")
    placed = work.keep(local.unionByName(anywhere), "terms")
    by_rarity = W.partitionBy("set_id", "repo").orderBy("nodes", "word")
    in_set = W.partitionBy("set_id", "repo")
    placed = work.keep(
        placed.withColumn("at", F.row_number().over(by_rarity))
        .withColumn("reach", F.count("*").over(in_set) - F.col("at") + 1),
        "terms-by-rarity",
    )
    by_degree = W.partitionBy("repo", "word").orderBy(F.desc("degree"), "number")
    heads = work.keep(
        index.withColumn("_at", F.row_number().over(by_degree)).filter(F.col("_at") <= top).drop("_at"), "heads"
    )
    node = ("set_id", "repo", "number", "degree")
    first = placed.filter("at = 1").join(index, ["repo", "word"]).select(*node).unionByName(
        placed.join(heads, ["repo", "word"]).select(*node)
    )
    seeds = work.keep(_words_hit(first.distinct(), index, placed), "seeds")
    ranked = W.partitionBy("set_id", "repo").orderBy(F.desc("words_hit"), F.desc("degree"), "number")
    bound = (
        seeds.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") == top)
        .select("set_id", "repo", F.col("words_hit").alias("least_hit"), F.col("degree").alias("least_degree"))
    )
    wanted = work.keep(
        placed.filter("at > 1").join(bound, ["set_id", "repo"], "left")
        .na.fill({"least_hit": 0, "least_degree": 0}).filter("reach >= least_hit")
        .select("set_id", "repo", "word", "reach", "least_hit", "least_degree"),
        "wanted",
    )
    more = (
        index.join(wanted, ["repo", "word"])
        .filter("reach > least_hit OR degree >= least_degree").select(*node).distinct()
        .join(seeds.select("set_id", "number"), ["set_id", "number"], "left_anti")
    )
    every = seeds.unionByName(_words_hit(more.select(*node), index, placed))
    best = work.keep(
        every.withColumn("rank", F.row_number().over(ranked).cast("bigint"))
        .filter(F.col("rank") <= top)
        .join(numbered.select("number", "node_id"), "number"),
        "best",
    )
    keys = sets.select(F.col("_asked").alias("_a"), F.col("words").alias("_w"), "set_id")
    return (
        asked.join(keys, F.col("_asked").eqNullSafe(F.col("_a")) & (F.col("words") == F.col("_w")))
        .join(best, "set_id")
        .select("query_id", "repo", "rank", "node_id", "words_hit", "degree")
    )
