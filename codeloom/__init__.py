"""Code-structure graphs on Spark: file tables in, graph tables out."""

from .operators.communities import communities, modularity, with_communities
from .operators.graph import Graph, build_graph, undirected
from .operators.metrics import adjacency, degrees, god_nodes
from .operators.pagerank import pagerank
from .operators.registry import register_extractor
from .operators.search import keyword_index, keyword_search
from .operators.smart import smart_graph
from .plans.jobs import Scan, export, pages, scan, views
from .sources.exports import (
    read_documents,
    read_export,
    write_export,
    write_pages,
)
from .sources.tree import files_from_table, read_listing, read_tree

__all__ = [
    "Graph", "Scan", "adjacency", "build_graph", "communities", "degrees", "export",
    "files_from_table", "god_nodes", "keyword_index", "keyword_search", "modularity",
    "pagerank", "pages", "read_documents", "read_export", "read_listing", "read_tree",
    "register_extractor", "scan", "smart_graph", "undirected", "views",
    "with_communities", "write_export", "write_pages",
]
