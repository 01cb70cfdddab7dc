"""Node and edge tables.

    nodes  repo, node_id, node_type, external, seq STRUCT<class, file, stage, pos>
    edges  repo, src, dst, type

``seq`` fixes an order where a file table has none: structure first, then
symbols, externals and unresolved targets, each by file, stage and position.
``file`` is the place of the file or folder among its repository's paths in order
(``number_paths``); nodes of equal ``seq`` follow each other by id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.names import normalise_id
from ..functions.work import (
    BROADCAST_ROWS, WorkTables, dealt, dense_index, distinct_rows, shuffled, small_side,
)

STRUCTURE, SYMBOL, EXTERNAL, UNRESOLVED = range(4)
NODE_COLUMNS = ("repo", "node_id", "node_type", "external", "seq")
EDGE_COLUMNS = ("repo", "src", "dst", "type")

# import kinds that name an edge type, and kinds that add no node
EDGE_KINDS = ("includes", "implements")
NODELESS_KINDS = (*EDGE_KINDS, "path", "resolved")


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    n_edges: int | None = None  # where the edges are written


SEQ_TYPE = "struct<class:int,file:bigint,stage:int,pos:bigint>"
# A candidate as one number: class 1, file 12, stage 4 digits; then pos 11, type 6, origin 1.
_STAGES, _TYPES = 10**4, 10**6
_CLASS, _LOWER = 10**16, 10**18


def seq(rank: int, file: Column, stage: Column, pos: Column) -> Column:
    return F.struct(
        F.lit(rank).alias("class"),
        file.cast("bigint").alias("file"),
        stage.cast("int").alias("stage"),
        pos.cast("bigint").alias("pos"),
    )


def number_paths(folders: DataFrame, files: DataFrame, work: WorkTables) -> tuple[DataFrame, int]:
    """(repo, file_id, file): the place of every folder and file among its repository's paths
    in order, and how many rows that are."""
    paths = folders.select("repo", F.col("folder").alias("file_id")).unionByName(
        files.select("repo", "file_id")
    )
    numbers = dense_index(paths.distinct(), ["repo"], ["file_id"], "file", work)
    numbers = work.keep(numbers.select("repo", "file_id", "file"), "path-numbers")
    return numbers, numbers.count()


def with_place(rows: DataFrame, numbers: tuple[DataFrame, int], path: str = "file_id") -> DataFrame:
    """Rows with the ``file`` number of the path in a column.  Rows beyond what may be
    broadcast are shuffled: the optimiser knows no size of facts and would broadcast them."""
    table, n = numbers
    table = table.withColumnRenamed("file_id", path)
    return rows.join(small_side(table, n) if n <= BROADCAST_ROWS else shuffled(table), ["repo", path])


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def first_wins(candidates: DataFrame, work: WorkTables | None = None) -> DataFrame:
    """One row per (repo, node_id): the type and origin that came first; of those at the
    same place the smaller type.

    Place, type and origin are packed into one number of fixed width whose order is
    theirs, so that the first one is a plain minimum: it is taken by hash aggregation, a
    partial one before the shuffle, without sorting candidates, and an id that a third of
    all files import arrives as one row per task.  Types stand in it by their number.
    """
    work = work or WorkTables(candidates.sparkSession)
    types = work.keep(
        candidates.select("node_type").filter("node_type is not null").distinct(), "node-types"
    )
    n_types = types.count()
    if n_types >= _TYPES:
        raise ValueError(f"more than {_TYPES} node types")
    # as few rows as there may be types
    types = types.withColumn("code", F.row_number().over(W.orderBy("node_type")))
    coded = candidates.filter("node_id is not null").join(
        small_side(types, n_types), "node_type", "left"
    )
    upper = F.col("seq.class") * _CLASS + F.col("seq.file") * _STAGES + F.col("seq.stage")
    lower = (
        F.col("seq.pos") * (_TYPES * 10) + F.coalesce("code", F.lit(0)) * 10
        + F.coalesce("external", F.lit(False)).cast("int")
    )
    key = upper.cast("decimal(17,0)") * F.lit(_LOWER).cast("decimal(19,0)") + lower.cast("decimal(18,0)")
    first = (
        coded.groupBy("repo", normalise_id(F.col("node_id")).alias("node_id"))
        .agg(F.min(key).alias("first"))
        .withColumn("upper", F.expr(f"first div {_LOWER}BD"))
        .withColumn("lower", F.expr(f"cast(first % {_LOWER}BD as bigint)"))
        .withColumn("code", F.expr(f"lower div 10 % {_TYPES}"))
    )
    return first.join(small_side(types, n_types), "code", "left").select(
        "repo", "node_id", "node_type", (F.col("lower") % 10 == 1).alias("external"),
        F.expr(
            f"named_struct('class', cast(upper div {_CLASS} as int), 'file', upper % {_CLASS} div {_STAGES}, "
            f"'stage', cast(upper % {_STAGES} as int), 'pos', lower div {_TYPES * 10})"
        ).alias("seq"),
    )


def distinct_edges(candidates: DataFrame, rows: int | None = None) -> DataFrame:
    """No empty ends, no self-edges, one row per (repo, src, dst, type).

    ``rows``, where the candidates are known to be so many at most and few of them alike,
    sets the number of tasks (``distinct_rows``)."""
    edges = candidates.select(
        "repo",
        normalise_id(F.col("src")).alias("src"),
        normalise_id(F.col("dst")).alias("dst"),
        "type",
    ).filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    return distinct_rows(edges, rows)


def structure_nodes(
    folders: DataFrame, file_nodes: DataFrame, numbers: tuple[DataFrame, int]
) -> DataFrame:
    zero = F.lit(0)
    return _union(
        [
            with_place(folders, numbers, "folder").select(
                "repo",
                F.col("folder").alias("node_id"),
                F.lit("folder").alias("node_type"),
                F.lit(False).alias("external"),
                seq(STRUCTURE, F.col("file"), zero, zero).alias("seq"),
            ),
            with_place(file_nodes.drop("folder"), numbers, "node_id").select(
                "repo",
                "node_id",
                "node_type",
                F.lit(False).alias("external"),
                seq(STRUCTURE, F.col("file"), F.lit(1), zero).alias("seq"),
            ),
        ]
    )


def structure_edges(folders: DataFrame, file_nodes: DataFrame) -> DataFrame:
    contains = F.lit("contains").alias("type")
    return _union(
        [
            folders.filter("parent is not null").select(
                "repo", F.col("parent").alias("src"), F.col("folder").alias("dst"), contains
            ),
            file_nodes.select(
                "repo", F.col("folder").alias("src"), F.col("node_id").alias("dst"), contains
            ),
        ]
    )


def definition_nodes(symbols: DataFrame) -> DataFrame:
    """Nodes of symbols, which carry their ``file`` number."""
    return symbols.select(
        "repo",
        "node_id",
        "node_type",
        F.lit(False).alias("external"),
        seq(SYMBOL, F.col("file"), F.col("stage"), F.col("pos")).alias("seq"),
    )


def definition_edges(symbols: DataFrame) -> DataFrame:
    return symbols.select(
        "repo",
        F.col("parent_id").alias("src"),
        F.col("node_id").alias("dst"),
        F.lit("defines").alias("type"),
    )


def import_nodes(imports: DataFrame) -> DataFrame:
    """Nodes of routed imports, which carry their ``file`` number; only an ``alias`` is
    internal."""
    return imports.filter(~F.col("kind").isin(*NODELESS_KINDS) & (F.col("raw") != "")).select(
        "repo",
        F.col("raw").alias("node_id"),
        F.col("kind").alias("node_type"),
        (F.col("kind") != "alias").alias("external"),
        seq(EXTERNAL, F.col("file"), F.col("stage"), F.col("pos")).alias("seq"),
    )


def import_edges(imports: DataFrame) -> DataFrame:
    return imports.select(
        "repo",
        F.col("file_id").alias("src"),
        F.col("raw").alias("dst"),
        F.when(F.col("kind").isin(*EDGE_KINDS), F.col("kind"))
        .otherwise("imports")
        .alias("type"),
    )


def type_edges(references: DataFrame) -> DataFrame:
    """(repo, func, type_name, kind) -> edges of kind ``param_type`` or
    ``return_type``, without empty and builtin names."""
    return references.filter(
        (F.col("type_name") != "") & ~F.col("type_name").isin(*fixed.BUILTIN_TYPES)
    ).select(
        "repo",
        F.col("func").alias("src"),
        F.col("type_name").alias("dst"),
        F.col("kind").alias("type"),
    )


def known_ids(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those rows of ``ids`` (repo, node_id, ...) whose id is a node."""
    return ids.join(shuffled(nodes.select("repo", "node_id")), ["repo", "node_id"], "left_semi")


def stub_links(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """Protobuf service -> generated stub, where the bare stub name is a node."""
    stem = F.regexp_replace(
        F.substring_index("file_id", "/", -1), r"(?s)(?<=.)\.[^.]*$", ""
    )
    stubs = (
        symbols.filter((F.col("node_type") == "service") & F.col("file_id").rlike(r"(?i)\.proto$"))
        .select("repo", F.col("node_id").alias("src"), stem.alias("stem"))
        .select(
            "repo",
            "src",
            F.explode(
                F.array(*[F.concat("stem", F.lit(s)) for s in fixed.PROTO_STUB_SUFFIXES])
            ).alias("node_id"),
        )
    )
    return known_ids(stubs, nodes).select(
        "repo", "src", F.col("node_id").alias("dst"), F.lit("generates").alias("type")
    )


def dangling_targets(nodes: DataFrame, edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Edge targets that are no node, as external ``unresolved`` nodes.  Targets
    are made distinct before the join, so a popular one is one row there; where it is known
    how many ``rows`` the edges are, that sets the number of tasks (``dealt``)."""
    targets = edges.select("repo", F.col("dst").alias("node_id")).distinct()
    missing = dealt(targets, rows, "repo", "node_id").join(
        shuffled(nodes.select("repo", "node_id")), ["repo", "node_id"], "left_anti"
    )
    return missing.select(
        "repo",
        "node_id",
        F.lit("unresolved").alias("node_type"),
        F.lit(True).alias("external"),
        seq(UNRESOLVED, F.lit(0), F.lit(0), F.lit(0)).alias("seq"),
    )


def with_dangling(nodes: DataFrame, edges: DataFrame, rows: int | None = None) -> DataFrame:
    return nodes.select(*NODE_COLUMNS).unionByName(dangling_targets(nodes, edges, rows))


def build_graph(
    node_rows: DataFrame, edge_rows: DataFrame, work: WorkTables | None = None
) -> Graph:
    """A graph from any node rows (repo, node_id, node_type, external[, seq SEQ_TYPE]) and
    edge rows (repo, src, dst, type).  With ``work`` the edge rows are counted
    and its tables written, so that everything derived from them starts there."""
    if "seq" not in node_rows.columns:
        node_rows = node_rows.withColumn(
            "seq", seq(STRUCTURE, F.lit(0), F.lit(0), F.lit(0))
        )
    nodes = first_wins(node_rows, work)
    if work is None:
        edges = distinct_edges(edge_rows)
        return Graph(with_dangling(nodes, edges), edges)
    nodes = work.keep(nodes, "known")
    edges = work.keep(distinct_edges(edge_rows, edge_rows.count()), "edges")
    rows = edges.count()
    return Graph(work.keep(with_dangling(nodes, edges, rows), "nodes"), edges, rows)


def pairs_of(graph: Graph) -> DataFrame:
    """One row per ordered pair, whatever the number of edge types on it."""
    return distinct_rows(graph.edges.select("repo", "src", "dst"), graph.n_edges)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(
        "repo", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    ).distinct()


def without_types(graph: Graph, types) -> Graph:
    """Remove the nodes of some types and every edge that touches one.

    Only the removed ids are joined against; an end that is no node at all
    (a focus run's outer folder) has no type and stays.
    """
    dropped = graph.nodes.filter(F.col("node_type").isin(*types)).select("repo", "node_id")
    edges = graph.edges
    for end in ("src", "dst"):
        edges = edges.join(
            shuffled(dropped.withColumnRenamed("node_id", end)), ["repo", end], "left_anti"
        )
    kept = graph.nodes.filter(~F.col("node_type").isin(*types))
    return Graph(kept, edges.select(*EDGE_COLUMNS))
