"""Whole jobs: file table -> graph -> views -> export and pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.work import WorkTables
from ..operators import graph as g
from ..operators import metrics, registry, render, resolve, structure
from ..operators.communities import communities, with_communities
from ..operators.facts import imports_of, symbols_of
from ..operators.graph import Graph
from ..operators.pagerank import pagerank
from ..operators.smart import smart_graph


@dataclass
class Scan:
    """The tables of one scan; ``files`` still has the text, nothing else does."""

    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    graph: Graph


def select_files(files: DataFrame, focus: str | None = None) -> DataFrame:
    """The files a scan reads: not pruned, in focus, of a supported kind."""
    kept = structure.focus_files(structure.prune_dirs(files), focus)
    return structure.supported_files(kept, registry.extensions())


def scan(
    files: DataFrame,
    focus: str | None = None,
    listing: DataFrame | None = None,
    work: WorkTables | None = None,
) -> Scan:
    """Extract and build the graph of a file table.

    ``listing`` names all files, also unsupported ones, for the folder nodes; by
    default it is the file table.  Paths and facts are written once and read back:
    nearly every step needs the paths, nodes and edges both need the facts, and the
    file table should be worked out, and its text scanned, once.
    """
    work = work or WorkTables(files.sparkSession)
    chosen = select_files(files, focus)
    listed = structure.focus_files(structure.prune_dirs(files), focus)
    listed = work.keep(listed.select("repo", "file_id", "dir", "name", "ext"), "paths")
    paths = structure.supported_files(listed, registry.extensions())
    all_paths = listed
    if listing is not None:
        all_paths = structure.focus_files(structure.prune_dirs(listing), focus)
    folders = work.keep(structure.folder_paths(all_paths, focus), "folders")
    file_nodes = structure.file_nodes(paths)
    numbers = g.number_paths(folders, paths, work)
    facts = work.keep(g.with_place(registry.extract_facts(chosen), numbers), "facts")
    symbols = symbols_of(facts)
    imports = work.keep(resolve.route_imports(imports_of(facts), paths), "imports")

    known = work.keep(
        g.first_wins(
            g.structure_nodes(folders, file_nodes, numbers)
            .unionByName(g.definition_nodes(symbols))
            .unionByName(g.import_nodes(imports)),
            work,
        ),
        "known",
    )
    edges = g.distinct_edges(
        g.structure_edges(folders, file_nodes)
        .unionByName(g.definition_edges(symbols))
        .unionByName(g.import_edges(imports))
        .unionByName(g.stub_links(symbols, known)),
        facts.count() + imports.count() + numbers[1],
    )
    edges = work.keep(edges, "edges")
    # folders, files and symbols are nodes already where their repository has a name
    outward = edges.filter(F.col("repo").isNull() | F.col("type").isin("imports", *g.EDGE_KINDS))
    n_edges = edges.count()
    nodes = work.keep(g.with_dangling(known, outward, n_edges), "nodes")
    return Scan(chosen, symbols, imports, Graph(nodes, edges, n_edges))


def views(
    graph: Graph, work: WorkTables | None = None, rounds: int | None = None
) -> dict[str, Graph]:
    """The ``classic`` and the ``smart`` view, nodes with their communities."""
    work = work or WorkTables(graph.nodes.sparkSession)
    labelled = with_communities(graph, communities(graph, work=work))
    labelled = Graph(work.keep(labelled.nodes, "labelled"), labelled.edges, labelled.n_edges)
    ranks = work.keep(pagerank(graph, rounds=rounds, work=work), "ranks")
    smart = smart_graph(labelled, ranks, work)
    edges = work.keep(smart.edges, "smart-edges")
    smart = Graph(smart.nodes, edges, edges.count())
    return {"classic": labelled, "smart": smart}


def export(
    scanned: Scan, top: int = 15, work: WorkTables | None = None
) -> tuple[dict[str, Graph], DataFrame]:
    """Both views and their metadata rows."""
    work = work or WorkTables(scanned.files.sparkSession)
    both = views(scanned.graph, work)
    stats = metrics.extract_stats(scanned.files, registry.methods())
    meta = metrics.graph_metadata(both["classic"], both, stats, top)
    return both, work.keep(meta, "metadata")


def pages(both: dict[str, Graph], metadata: DataFrame) -> DataFrame:
    """(repo, mode, page, body) of all node and index pages."""
    out = render.index_pages(metadata)
    for mode, graph in both.items():
        out = out.unionByName(render.node_pages(graph, mode).drop("node_id"))
    return out


def most_connected(scanned: Scan, top: int = fixed.DEFAULT_GOD_NODES) -> DataFrame:
    """The flagship query: each repository's best connected internal nodes."""
    return metrics.god_nodes(scanned.graph, top).filter("not external").drop("external")
