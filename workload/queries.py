"""Registered queries: each a Spark query and, where SQL can say it, the check."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import fixed_values as fixed
from codeloom.functions.names import normalise_id, page_name, wiki_link
from codeloom.functions.text import decode_text
from codeloom.functions.work import WorkTables, dense_index
from codeloom.operators import graph as g
from codeloom.operators import metrics, registry, render, resolve, rules, structure
from codeloom.operators.communities import communities, modularity
from codeloom.operators.facts import explode_facts, imports_of, symbols_of
from codeloom.operators.graph import Graph
from codeloom.operators.javascript_source import script_facts
from codeloom.operators.pagerank import pagerank
from codeloom.operators.parsed import python_found
from codeloom.operators.search import keyword_index, keyword_search
from codeloom.operators.smart import smart_graph
from codeloom.plans import jobs
from codeloom.sources import exports, tree

from . import check_sql as sql
from . import sources
from .templates import JS_FAMILY

ROUNDS = 20
SCAN_DATE = "2024-01-01T00:00:00"

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, tuple[Query, str | None]] = {}


def query(name: str, check: str | None = None):
    def add(fn: Query) -> Query:
        REGISTERED[name] = (fn, check)
        return fn

    return add


@lru_cache(maxsize=8)
def _scan(session: str, spark: SparkSession, sf_dir: str) -> jobs.Scan:
    return jobs.scan(sources.source_files(spark, sf_dir))


def scanned(spark: SparkSession, sf_dir: str) -> jobs.Scan:
    """The source files' graph, written once per session and read by all queries
    that start from a graph."""
    return _scan(spark.sparkContext.applicationId, spark, sf_dir)


@lru_cache(maxsize=8)
def _fk_graph(session: str, spark: SparkSession, sf_dir: str) -> Graph:
    return sources.fk_graph(spark, sf_dir)


def fk_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return _fk_graph(spark.sparkContext.applicationId, spark, sf_dir)


@lru_cache(maxsize=8)
def _ranks(session: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = scanned(spark, sf_dir).graph
    return pagerank(graph, rounds=ROUNDS)


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark.sparkContext.applicationId, spark, sf_dir)


@lru_cache(maxsize=8)
def _grouped(session: str, spark: SparkSession, sf_dir: str) -> Graph:
    graph = scanned(spark, sf_dir).graph
    owner = F.substring_index("node_id", "::", 1)
    owned = graph.nodes.filter(
        ~F.col("external") & ~F.col("node_type").isin("folder", "alias")
    ).select("repo", "node_id", owner.alias("owner"))
    work = WorkTables(spark)
    numbers = dense_index(
        owned.select("repo", "owner").distinct(), ["repo"], ["owner"], "community", work
    )
    nodes = graph.nodes.join(
        owned.join(numbers, ["repo", "owner"]).drop("owner"), ["repo", "node_id"], "left"
    ).withColumn("community", F.coalesce("community", F.lit(-1)).cast("int"))
    return Graph(work.keep(nodes, "grouped"), graph.edges, graph.n_edges)


def grouped(spark: SparkSession, sf_dir: str) -> Graph:
    """The same graph, each file with its symbols being one community."""
    return _grouped(spark.sparkContext.applicationId, spark, sf_dir)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.select_files(sources.source_files(spark, sf_dir))


# ------------------------------------------------------------------ file tables


@query("file_classify", f"""{sql.BASE}
SELECT repo, file_id, {sql.FILE_CLASS} AS node_type FROM files""")
def file_classify(spark, sf_dir):
    nodes = structure.file_nodes(_files(spark, sf_dir))
    return nodes.select("repo", F.col("node_id").alias("file_id"), "node_type")


@query("prune_dirs", f"{sql.BASE} SELECT repo, file_id FROM pruned")
def prune_dirs(spark, sf_dir):
    return structure.prune_dirs(sources.source_files(spark, sf_dir)).select("repo", "file_id")


@query("focus_files", f"""{sql.BASE}
SELECT repo, file_id FROM files WHERE starts_with(file_id, 'economy/')""")
def focus_files(spark, sf_dir):
    files = sources.source_files(spark, sf_dir)
    return jobs.select_files(files, "economy").select("repo", "file_id")


@query("supported_files", f"""{sql.BASE}
SELECT repo, file_id, ext FROM all_files WHERE ext <> '.txt'""")
def supported_files(spark, sf_dir):
    files = sources.source_files(spark, sf_dir)
    return structure.supported_files(files, registry.extensions()).select("repo", "file_id", "ext")


@query("normalise_ids", """SELECT page_id, url AS id FROM pages""")
def normalise_ids(spark, sf_dir):
    windows = F.translate("url", "/", "\\")
    return sources.table(spark, sf_dir, "pages").select(
        "page_id", normalise_id(windows).alias("id")
    )


@query("decode_text", """SELECT src, id, length(t)::BIGINT AS chars, md5(t) AS digest FROM (
  SELECT 'page' AS src, page_id AS id,
    replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM pages
  UNION ALL SELECT 'document', doc_id,
    replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) FROM documents)""")
def decoded_text(spark, sf_dir):
    def rows(name, key, column):
        return sources.table(spark, sf_dir, name).select(
            F.lit(name[:-1]).alias("src"), F.col(key).alias("id"),
            decode_text(F.col(column).cast("binary")).alias("t"),
        )

    both = rows("pages", "page_id", "html").unionByName(rows("documents", "doc_id", "text"))
    return both.select(
        "src", "id", F.length("t").cast("bigint").alias("chars"),
        F.md5(F.col("t").cast("binary")).alias("digest"),
    )


@query("folder_tree", f"""{sql.BASE}, {sql.FOLDERS} SELECT repo, folder, parent FROM folders""")
def folder_tree(spark, sf_dir):
    return structure.folder_paths(structure.prune_dirs(sources.source_files(spark, sf_dir)))


@query("suffix_index", f"{sql.BASE}, {sql.SUFFIXES} SELECT repo, suffix, file_id FROM suffixes")
def suffix_index(spark, sf_dir):
    return structure.suffix_index(_files(spark, sf_dir))


@query("python_modules", f"""{sql.BASE}
SELECT repo, regexp_replace(replace(file_id, '/', '.'), '[.]py$', '') AS module,
  max(file_id) AS file_id FROM files WHERE ext = '.py' GROUP BY ALL""")
def python_modules(spark, sf_dir):
    return structure.module_map(_files(spark, sf_dir))


# ------------------------------------------------------------------- extraction


def _both(facts: DataFrame, with_pos: bool = True) -> DataFrame:
    """Symbols and imports of facts in one table."""
    found = symbols_of(facts).select(
        "repo", "file_id", "stage", "pos", F.lit("symbol").alias("what"),
        F.col("parent_id").alias("owner"), F.col("node_id").alias("target"),
        F.col("node_type").alias("type"),
    ).unionByName(
        imports_of(facts).select(
            "repo", "file_id", "stage", "pos", F.lit("import").alias("what"),
            F.col("file_id").alias("owner"), F.col("raw").alias("target"),
            F.col("kind").alias("type"),
        )
    )
    return found if with_pos else found.drop("stage", "pos")


def _both_sql(exts, kinds=None, with_pos=True, which=("symbols", "imports")) -> str:
    place = "stage, pos, " if with_pos else ""
    some = f"chosen AS (SELECT * FROM files WHERE ext IN {sql.in_list(exts)}"
    some += f" AND kind IN {sql.in_list(kinds)})" if kinds else ")"
    return f"""{sql.BASE}, {some}, {sql.symbols("chosen", which[0])}, {sql.imports("chosen", which[1])}
SELECT repo, file_id, {place}'symbol' AS what, parent_id AS owner, node_id AS target,
  node_type AS type FROM symbols
UNION ALL SELECT repo, file_id, {place}'import', file_id, raw, kind FROM imports"""


def _register_rules():
    for language, (exts, _) in rules.LANGUAGES.items():

        def run(spark, sf_dir, language=language, exts=exts):
            files = structure.supported_files(_files(spark, sf_dir), exts)
            return _both(
                explode_facts(files, rules.language_facts(language, F.col("content")))
            )

        query(f"extract_{language}", _both_sql(exts))(run)


_register_rules()


def _python(spark, sf_dir, parsed: bool) -> DataFrame:
    files = structure.supported_files(_files(spark, sf_dir), [".py"])
    found = python_found(files).filter(F.col("parsed") == F.lit(parsed))
    return _both(found.select("repo", "file_id", F.explode("found").alias("f")).select(
        "repo", "file_id", "f.*"))


@query("extract_python", _both_sql([".py"], ["py", "pystub"]))
def extract_python(spark, sf_dir):
    return _python(spark, sf_dir, True)


@query("extract_python_fallback", _both_sql([".py"], ["pybad"]))
def extract_python_fallback(spark, sf_dir):
    return _python(spark, sf_dir, False)


def _js_files(spark, sf_dir):
    exts = ["." + e for e in JS_FAMILY]
    return structure.supported_files(_files(spark, sf_dir), exts)


JS_EXTS = ["." + e for e in JS_FAMILY]


@query("extract_js", _both_sql(JS_EXTS, with_pos=False))
def extract_js(spark, sf_dir):
    return _both(script_facts(_js_files(spark, sf_dir)), with_pos=False)


@query("extract_js_regex", _both_sql(JS_EXTS, which=("rule_symbols", "rule_imports")))
def extract_js_regex(spark, sf_dir):
    return _both(registry.js_rule_extractor(_js_files(spark, sf_dir)))


IMPORTS = ",\n".join([sql.BASE, sql.imports(), sql.REQUESTS, sql.resolved()])


@query("js_imports", f"""{IMPORTS}, {sql.ROUTED}
SELECT repo, file_id, raw, kind FROM routed WHERE kind IN ('npm_package', 'alias', 'resolved')""")
def js_imports(spark, sf_dir):
    routed = scanned(spark, sf_dir).imports
    return routed.filter(F.col("kind").isin("npm_package", "alias", "resolved")).select(
        "repo", "file_id", "raw", "kind"
    )


@query("resolve_alias", f"""{sql.BASE}, requests AS (
  SELECT repo, file_id, alias FROM files UNION SELECT repo, file_id, 'helper' FROM files),
{sql.resolved()} SELECT repo, file_id, alias, target FROM resolved""")
def resolve_alias(spark, sf_dir):
    """Every file asks for a stem that several files may have, and for ``helper``,
    which very many have."""
    files = _files(spark, sf_dir)
    stems = sources.with_alias(spark, sf_dir).join(
        files.select("repo", "file_id"), ["repo", "file_id"], "left_semi"
    )
    asked = stems.unionByName(
        files.select("repo", "file_id", F.lit("helper").alias("alias"))
    )
    return resolve.resolve_aliases(asked, files)


@query("page_link_alias", f"""{sql.PAGE_LINKS},
files AS (SELECT DISTINCT repo, src AS file_id FROM links),
requests AS (SELECT DISTINCT repo, src AS file_id, dst AS alias FROM edges),
{sql.resolved()},
target AS (SELECT r.repo, r.file_id, r.alias, t.target FROM requests r
  LEFT JOIN resolved t USING (repo, file_id, alias))
SELECT repo, count(*) AS asked, count(target) AS found FROM target GROUP BY repo""")
def page_link_alias(spark, sf_dir):
    links = sources.page_links(spark, sf_dir)
    asked = g.distinct_edges(links).select(
        "repo", F.col("src").alias("file_id"), F.col("dst").alias("alias")
    )
    files = links.select("repo", F.col("src").alias("file_id")).distinct()
    found = resolve.resolve_aliases(asked, files)
    return (
        asked.join(found, ["repo", "file_id", "alias"], "left")
        .groupBy("repo")
        .agg(F.count("*").alias("asked"), F.count("target").alias("found"))
    )


# ----------------------------------------------------------------- graph tables


@query("build_nodes", f"{sql.SOURCE_GRAPH} SELECT repo, node_id, node_type, external FROM nodes")
def build_nodes(spark, sf_dir):
    return scanned(spark, sf_dir).graph.nodes.select("repo", "node_id", "node_type", "external")


@query("build_edges", f"{sql.SOURCE_GRAPH} SELECT repo, src, dst, type FROM edges")
def build_edges(spark, sf_dir):
    return scanned(spark, sf_dir).graph.edges.select(*g.EDGE_COLUMNS)


@query("build_fk_nodes", f"{sql.FK_GRAPH} SELECT repo, node_id, node_type, external FROM nodes")
def build_fk_nodes(spark, sf_dir):
    return fk_graph(spark, sf_dir).nodes.select("repo", "node_id", "node_type", "external")


@query("build_fk_edges", f"{sql.FK_GRAPH} SELECT repo, src, dst, type FROM edges")
def build_fk_edges(spark, sf_dir):
    return fk_graph(spark, sf_dir).edges


@query("dangling", f"""{sql.PAGE_LINKS}
SELECT DISTINCT repo, dst AS node_id, 'unresolved' AS node_type, true AS external FROM edges e
WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.repo = e.repo AND l.src = e.dst)""")
def dangling(spark, sf_dir):
    links = sources.page_links(spark, sf_dir)
    nodes = links.select("repo", F.col("src").alias("node_id")).distinct()
    return g.dangling_targets(nodes, g.distinct_edges(links)).drop("seq")


TYPE_NAMES = ("int", "str", "None", "Order", "Customer", "dict", "Invoice", "")


@query("type_edges", f"""WITH named AS (
  SELECT strftime(ts, '%Y-%m-%d') AS repo, 'user/' || user_id AS src,
    {sql._list(TYPE_NAMES)}[(event_id % {len(TYPE_NAMES)} + 1)::INT] AS dst,
    CASE WHEN event_id % 2 = 0 THEN 'param_type' ELSE 'return_type' END AS type FROM events)
SELECT DISTINCT repo, src, dst, type FROM named
WHERE dst NOT IN ('int', 'str', 'None', 'dict', '')""")
def type_edges(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in TYPE_NAMES])
    references = sources.table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("repo"),
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("func"),
        F.get(names, (F.col("event_id") % len(TYPE_NAMES)).cast("int")).alias("type_name"),
        F.when(F.col("event_id") % 2 == 0, "param_type").otherwise("return_type").alias("kind"),
    )
    return g.distinct_edges(g.type_edges(references))


@query("stub_links", f"{sql.SOURCE_GRAPH} SELECT repo, src, dst, type FROM edges WHERE type = 'generates'")
def stub_links(spark, sf_dir):
    scan = scanned(spark, sf_dir)
    return g.stub_links(scan.symbols, scan.graph.nodes)


@query("known_ids", f"""{sql.SOURCE_GRAPH}, asked AS (SELECT DISTINCT repo, raw AS node_id FROM routed)
SELECT repo, node_id FROM asked WHERE (repo, node_id) IN (SELECT repo, node_id FROM known)""")
def known_ids(spark, sf_dir):
    scan = scanned(spark, sf_dir)
    asked = scan.imports.select("repo", F.col("raw").alias("node_id")).distinct()
    return g.known_ids(asked, scan.graph.nodes.filter("node_type <> 'unresolved'"))


# ---------------------------------------------------------------------- metrics


@query("degrees", f"{sql.FK_GRAPH}, {sql.PAIRS}, {sql.DEGREES} SELECT repo, node_id, degree FROM degrees")
def degrees(spark, sf_dir):
    return metrics.degrees(fk_graph(spark, sf_dir))


@query("degrees_events", f"""{sql.EVENT_GRAPH}, {sql.PAIRS}, {sql.DEGREES}
SELECT repo, node_id, degree FROM degrees""")
def degrees_events(spark, sf_dir):
    return metrics.degrees(sources.event_graph(spark, sf_dir))


GODS = "SELECT repo, external, rank, node_id, degree FROM gods"


@query("god_nodes", f"{sql.FK_GRAPH}, {sql.PAIRS}, {sql.DEGREES}, {sql.gods(15)} {GODS}")
def god_nodes(spark, sf_dir):
    return metrics.god_nodes(fk_graph(spark, sf_dir), 15)


@query("god_nodes_source", f"{sql.SOURCE_GRAPH}, {sql.PAIRS}, {sql.DEGREES}, {sql.gods(10)} {GODS}")
def god_nodes_source(spark, sf_dir):
    return metrics.god_nodes(scanned(spark, sf_dir).graph)


@query("most_connected", f"""{sql.SOURCE_GRAPH}, {sql.PAIRS}, {sql.DEGREES}, {sql.gods(10)}
SELECT repo, rank, node_id, degree FROM gods WHERE NOT external""")
def most_connected(spark, sf_dir):
    return jobs.most_connected(scanned(spark, sf_dir))


@query("extract_stats", f"""{sql.BASE} SELECT repo, ext[2:] AS ext, count(*) AS files,
  CASE WHEN ext = '.py' THEN 'python-ast' WHEN ext IN {sql.in_list(JS_EXTS)} THEN 'tokens'
       ELSE 'regex' END AS method FROM files GROUP BY ALL""")
def extract_stats(spark, sf_dir):
    return metrics.extract_stats(_files(spark, sf_dir), registry.methods())


SMART = ",\n".join([sql.SOURCE_GRAPH, sql.ranks(ROUNDS), sql.KEEP, sql.SMART_EDGES])


@lru_cache(maxsize=8)
def _views(session: str, spark: SparkSession, sf_dir: str) -> dict[str, Graph]:
    classic, work = grouped(spark, sf_dir), WorkTables(spark)
    smart = smart_graph(classic, ranks(spark, sf_dir), work)
    edges = work.keep(smart.edges, "smart-edges")
    return {"classic": classic, "smart": Graph(smart.nodes, edges, edges.count())}


def _both_views(spark, sf_dir) -> dict[str, Graph]:
    """Both views, the smart one written once per session and read by all that render it."""
    return _views(spark.sparkContext.applicationId, spark, sf_dir)


def _metadata(spark, sf_dir) -> DataFrame:
    views = _both_views(spark, sf_dir)
    stats = metrics.extract_stats(_files(spark, sf_dir), registry.methods())
    return metrics.graph_metadata(views["classic"], views, stats, 30, scan_date=SCAN_DATE)


TOTALS = f"""modes AS (
  SELECT repo, 'classic' AS mode FROM nodes GROUP BY repo
  UNION ALL SELECT repo, 'smart' FROM nodes GROUP BY repo),
totals AS (
  SELECT m.repo, m.mode,
    (SELECT count(*) FROM (SELECT repo, 'classic' AS mode FROM nodes
      UNION ALL SELECT repo, 'smart' FROM kept) x WHERE x.repo = m.repo AND x.mode = m.mode) AS total_nodes,
    (SELECT count(*) FROM (SELECT repo, 'classic' AS mode FROM edges
      UNION ALL SELECT repo, 'smart' FROM smart) x WHERE x.repo = m.repo AND x.mode = m.mode) AS total_edges
  FROM modes m)"""


@query("graph_metadata", f"""{SMART}, {sql.DEGREES}, {sql.gods(30)}, {sql.BY_FILE}, {TOTALS}
SELECT t.repo AS project, t.mode, t.total_nodes, t.total_edges,
  (SELECT count(DISTINCT community) FROM grouped x WHERE x.repo = t.repo AND community <> -1)
    AS communities_count,
  (SELECT string_agg(node_id || '=' || degree, ' ' ORDER BY rank) FROM gods x
   WHERE x.repo = t.repo AND NOT external) AS internal,
  (SELECT string_agg(node_id || '=' || degree, ' ' ORDER BY rank) FROM gods x
   WHERE x.repo = t.repo AND external) AS external,
  (SELECT string_agg(e || '=' || n || ' ' || m, ' ' ORDER BY e) FROM (
     SELECT f.repo, ext[2:] AS e, count(*) AS n,
       CASE WHEN ext = '.py' THEN 'python-ast' WHEN ext IN {sql.in_list(JS_EXTS)} THEN 'tokens'
            ELSE 'regex' END AS m FROM files f GROUP BY ALL) x WHERE x.repo = t.repo) AS parser_info
FROM totals t""")
def graph_metadata(spark, sf_dir):
    def listed(items: Column) -> Column:
        return F.array_join(
            F.transform(items, lambda x: F.concat_ws("=", x["node"], x["degree"].cast("string"))),
            " ",
        )

    info = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("parser_info")),
            lambda e: F.concat(
                e["key"], F.lit("="), e["value"]["files"].cast("string"), F.lit(" "),
                e["value"]["method"],
            ),
        ),
        " ",
    )
    return _metadata(spark, sf_dir).select(
        "project", "mode", "total_nodes", "total_edges", "communities_count",
        listed(F.col("god_nodes.internal")).alias("internal"),
        listed(F.col("god_nodes.external")).alias("external"),
        info.alias("parser_info"),
    )


@query("adjacency", f"""{sql.SOURCE_GRAPH}
SELECT repo, src AS node_id, 'out' AS direction, type, dst AS neighbour FROM edges
UNION ALL SELECT repo, dst, 'in', type, src FROM edges""")
def adjacency(spark, sf_dir):
    return metrics.adjacency(scanned(spark, sf_dir).graph.edges)


@query("capped_neighbours", f"""{sql.FK_GRAPH}, lists AS (
  SELECT repo, src AS node_id, 'out' AS direction, type, dst AS neighbour FROM edges
  UNION ALL SELECT repo, dst, 'in', type, src FROM edges)
SELECT repo, node_id, direction, type,
  string_agg(neighbour, ' ' ORDER BY neighbour) AS neighbours FROM (
  SELECT * FROM lists QUALIFY row_number() OVER (
    PARTITION BY repo, node_id, direction, type ORDER BY neighbour) <= 25) GROUP BY ALL""")
def capped_neighbours(spark, sf_dir):
    graph = fk_graph(spark, sf_dir)
    lists = metrics.capped_neighbours(metrics.adjacency(graph.edges), rows=2 * graph.n_edges)
    return lists.withColumn("neighbours", F.array_join("neighbours", " "))


@query("incoming_internal", f"""{sql.EVENT_GRAPH}
SELECT repo, src, dst, type FROM edges e WHERE NOT EXISTS (
  SELECT 1 FROM nodes n WHERE n.repo = e.repo AND n.node_id = e.src AND n.external)""")
def incoming_internal(spark, sf_dir):
    graph = sources.event_graph(spark, sf_dir)
    return metrics.internal_sources(graph.edges, graph.nodes).select(*g.EDGE_COLUMNS)


@query("community_members", f"""{sql.SOURCE_GRAPH}, {sql.BY_FILE}
SELECT repo, community, node_id FROM grouped WHERE community <> -1""")
def community_members(spark, sf_dir):
    return metrics.community_members(grouped(spark, sf_dir).nodes)


@query("community_peers", f"""{sql.SOURCE_GRAPH}, {sql.BY_FILE}
SELECT repo, community, string_agg(node_id, ' ' ORDER BY node_id) AS first FROM (
  SELECT * FROM grouped WHERE community <> -1 AND NOT external QUALIFY row_number() OVER (
    PARTITION BY repo, community ORDER BY node_id) <= 16) GROUP BY ALL""")
def community_peers(spark, sf_dir):
    return render.peers(grouped(spark, sf_dir).nodes).withColumn(
        "first", F.array_join("first", " ")
    )


# -------------------------------------------------------------------- analytics


@query("undirected", f"""{sql.SOURCE_GRAPH}
SELECT DISTINCT repo, least(src, dst) AS a, greatest(src, dst) AS b FROM edges""")
def undirected(spark, sf_dir):
    return g.undirected(scanned(spark, sf_dir).graph.edges)


@query("without_types", f"""{sql.SOURCE_GRAPH}, gone AS (
  SELECT repo, node_id FROM nodes WHERE node_type IN ('unresolved', 'folder'))
SELECT repo, src, dst, type FROM edges WHERE (repo, src) NOT IN (SELECT repo, node_id FROM gone)
  AND (repo, dst) NOT IN (SELECT repo, node_id FROM gone)""")
def without_types(spark, sf_dir):
    graph = scanned(spark, sf_dir).graph
    return g.without_types(graph, ("unresolved", "folder")).edges


@query("pagerank", f"""{sql.EVENT_GRAPH}, {sql.ranks(ROUNDS)}
SELECT repo, node_id, round(rank, 8) AS rank FROM ranks""")
def pagerank_events(spark, sf_dir):
    found = pagerank(sources.event_graph(spark, sf_dir), rounds=ROUNDS)
    return found.withColumn("rank", F.round("rank", 8))


@query("pagerank_source", f"""{sql.SOURCE_GRAPH}, {sql.ranks(ROUNDS)}
SELECT repo, node_id, round(rank, 8) AS rank FROM ranks""")
def pagerank_source(spark, sf_dir):
    return ranks(spark, sf_dir).withColumn("rank", F.round("rank", 8))


@query("pagerank_settled", f"{sql.EVENT_GRAPH}, {sql.settled_ranks()} SELECT repo, node_id, round(rank, 8) AS rank FROM ranks")
def pagerank_settled(spark, sf_dir):
    """Each repository to its own convergence, as the smart view uses it."""
    return pagerank(sources.event_graph(spark, sf_dir)).withColumn("rank", F.round("rank", 8))


@query("smart_nodes", f"{SMART} SELECT repo, node_id, node_type FROM kept")
def smart_nodes(spark, sf_dir):
    view = smart_graph(scanned(spark, sf_dir).graph, ranks(spark, sf_dir))
    return view.nodes.select("repo", "node_id", "node_type")


@query("smart_edges", f"{SMART} SELECT repo, src, dst, type FROM smart")
def smart_edges(spark, sf_dir):
    graph = scanned(spark, sf_dir).graph
    return smart_graph(graph, ranks(spark, sf_dir), WorkTables(spark)).edges


@query("modularity_by_file", f"""{sql.SOURCE_GRAPH}, {sql.BY_FILE},
links AS (SELECT DISTINCT repo, least(src, dst) AS a, greatest(src, dst) AS b FROM edges),
labels AS (SELECT l.repo, x.community AS ca, y.community AS cb FROM links l
  JOIN labelled x ON x.repo = l.repo AND x.node_id = l.a
  JOIN labelled y ON y.repo = l.repo AND y.node_id = l.b),
size AS (SELECT repo, count(*)::DOUBLE AS m, sum((ca = cb)::INT) AS inside FROM labels GROUP BY repo),
deg AS (SELECT repo, c, count(*)::DOUBLE AS d FROM (
  SELECT repo, ca AS c FROM labels UNION ALL SELECT repo, cb FROM labels) GROUP BY ALL)
SELECT s.repo, round(s.inside / s.m - (SELECT sum(d * d) FROM deg WHERE deg.repo = s.repo)
  / (4 * s.m * s.m), 8) AS modularity FROM size s""")
def modularity_by_file(spark, sf_dir):
    graph = grouped(spark, sf_dir)
    members = metrics.community_members(graph.nodes)
    known = g.Graph(graph.nodes, graph.edges)
    found = modularity(members, g.undirected(known.edges))
    return found.withColumn("modularity", F.round("modularity", 8))


@lru_cache(maxsize=8)
def _communities(session: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities(scanned(spark, sf_dir).graph)


@query("communities")
def found_communities(spark, sf_dir):
    return _communities(spark.sparkContext.applicationId, spark, sf_dir)


@query("communities_check", f"""{sql.SOURCE_GRAPH}
SELECT repo, count(*) FILTER (node_type NOT IN {sql.in_list(fixed.COMMUNITY_SKIP_TYPES)}) AS inside,
  count(*) FILTER (node_type IN {sql.in_list(fixed.COMMUNITY_SKIP_TYPES)}) AS outside,
  TRUE AS once_each, TRUE AS dense_from_0, TRUE AS not_below_files, TRUE AS not_below_single
FROM nodes GROUP BY repo""")
def communities_check(spark, sf_dir):
    """What every right answer has in common: who is in a community, ids, quality."""
    graph = scanned(spark, sf_dir).graph
    found = found_communities(spark, sf_dir)
    members = found.filter("community >= 0")
    links = g.undirected(g.without_types(graph, fixed.COMMUNITY_SKIP_TYPES).edges)
    owner = F.xxhash64(F.substring_index("node_id", "::", 1))

    def quality(labels, name):
        return modularity(labels, links).withColumnRenamed("modularity", name)

    counts = found.groupBy("repo").agg(
        F.count_if(F.col("community") >= 0).alias("inside"),
        F.count_if(F.col("community") == -1).alias("outside"),
        (F.count("*") == F.count_distinct("node_id")).alias("once_each"),
        (F.max("community") + 1 == F.count_distinct(F.when(F.col("community") >= 0, F.col("community"))))
        .alias("dense_from_0"),
    )
    rated = (
        quality(members, "own")
        .join(quality(members.withColumn("community", owner), "files"), "repo")
        .join(quality(members.withColumn("community", F.xxhash64("node_id")), "single"), "repo")
    )
    return counts.join(rated, "repo", "left").select(
        "repo", "inside", "outside", "once_each", "dense_from_0",
        F.coalesce(F.col("own") >= F.col("files") - 1e-9, F.lit(True)).alias("not_below_files"),
        F.coalesce(F.col("own") >= F.col("single") - 1e-9, F.lit(True)).alias("not_below_single"),
    )


# -------------------------------------------------------------------- rendering


@query("page_names", f"""SELECT page_id, {sql.page_name('url')} AS url_page, {sql.wiki('url')} AS link,
  {sql.page_name('html')} AS html_page FROM pages""")
def page_names(spark, sf_dir):
    return sources.table(spark, sf_dir, "pages").select(
        "page_id", page_name(F.col("url")).alias("url_page"),
        wiki_link(F.col("url")).alias("link"), page_name(F.col("html")).alias("html_page"),
    )


def _pages_sql(mode: str, nodes: str, edges: str, hidden: str, peers: bool) -> str:
    peer_cte = f""",
peer_list AS (
  SELECT w.repo, w.node_id, list({sql.wiki('p.node_id')} ORDER BY p.node_id)[1:15] AS links
  FROM wanted w JOIN {nodes} p ON p.repo = w.repo AND p.community = w.community
    AND p.node_id <> w.node_id AND NOT p.external
  WHERE w.community <> -1 GROUP BY ALL)""" if peers else ""
    peer_text = (
        "|| CASE WHEN p.links IS NULL THEN '' ELSE chr(10) || '## 🏘️ Same Module (Community)' || "
        "chr(10) || array_to_string(list_transform(p.links, lambda x: '- ' || x), chr(10)) || chr(10) END"
    ) if peers else ""
    peer_join = "LEFT JOIN peer_list p USING (repo, node_id)" if peers else ""
    return f"""
wanted AS (
  SELECT n.*, {sql.page_name('n.node_id')} AS page FROM {nodes} n
  WHERE NOT n.external AND {hidden}),
winners AS (
  SELECT * FROM wanted QUALIFY row_number() OVER (
    PARTITION BY repo, page ORDER BY c DESC, f DESC, stage DESC, pos DESC) = 1),
lists AS (
  SELECT repo, src AS node_id, 'out' AS way, type, dst AS other FROM {edges}
  UNION ALL SELECT e.repo, e.dst, 'in', e.type, e.src FROM {edges} e WHERE NOT EXISTS (
    SELECT 1 FROM {nodes} n WHERE n.repo = e.repo AND n.node_id = e.src AND n.external)),
blocks AS (
  SELECT repo, node_id, way, type, chr(10) || '**' || upper(type[1]) || lower(type[2:]) || ':**'
    || string_agg(chr(10) || '- ' || {sql.wiki('other')}, '' ORDER BY other) AS block
  FROM (SELECT * FROM lists QUALIFY row_number() OVER (
    PARTITION BY repo, node_id, way, type ORDER BY other) <= 25)
  GROUP BY repo, node_id, way, type),
sides AS (
  SELECT repo, node_id,
    string_agg(block, '' ORDER BY type) FILTER (way = 'out') AS outs,
    string_agg(block, '' ORDER BY type) FILTER (way = 'in') AS ins
  FROM blocks GROUP BY ALL){peer_cte}
SELECT w.repo, '{mode}' AS mode, w.page, w.node_id,
  '# ' || w.node_id || chr(10) || chr(10) || 'type:: ' || w.node_type
  || CASE WHEN w.community <> -1 THEN chr(10) || 'community:: ' || w.community ELSE '' END
  || chr(10)
  || CASE WHEN s.outs IS NULL THEN '' ELSE chr(10) || '## → Outgoing' || s.outs || chr(10) END
  || CASE WHEN s.ins IS NULL THEN '' ELSE chr(10) || '## ← Incoming' || s.ins || chr(10) END
  {peer_text} AS body
FROM winners w LEFT JOIN sides s USING (repo, node_id) {peer_join}"""


HIDDEN = """(NOT contains(n.node_id, '::') OR NOT (
  length(substr(n.node_id, position('::' IN n.node_id) + 2)) < 2
  OR starts_with(substr(n.node_id, position('::' IN n.node_id) + 2), '_')))"""


@query("node_pages", f"{sql.SOURCE_GRAPH}, {sql.BY_FILE}, " + _pages_sql(
    "classic", "grouped", "edges", HIDDEN, False))
def node_pages(spark, sf_dir):
    return render.node_pages(grouped(spark, sf_dir), "classic")


@query("node_pages_smart", SMART + f", {sql.BY_FILE}, shown AS (SELECT g.* FROM grouped g JOIN kept k"
       " USING (repo, node_id)), " + _pages_sql("smart", "shown", "smart", "true", True))
def node_pages_smart(spark, sf_dir):
    return render.node_pages(_both_views(spark, sf_dir)["smart"], "smart")


@query("index_page", f"""{SMART}, {sql.DEGREES}, {sql.gods(30)}, {TOTALS}
SELECT t.repo, t.mode, 'INDEX' AS page, '# ' || t.repo || ' Architecture ('
  || upper(t.mode[1]) || t.mode[2:] || ' Mode)' || chr(10) || chr(10) || 'Nodes: '
  || format('{{:,}}', t.total_nodes) || ' | Generated: {SCAN_DATE}' || chr(10) || chr(10)
  || '## 🔥 Top God Nodes' || coalesce((SELECT string_agg(chr(10) || '- ' || {sql.wiki('node_id')}
    || ' (' || degree || ' connections)', '' ORDER BY rank) FROM gods x
    WHERE x.repo = t.repo AND NOT external), '') AS body FROM totals t""")
def index_page(spark, sf_dir):
    return render.index_pages(_metadata(spark, sf_dir))


# ------------------------------------------------------------------ round trips


@query("export_round_trip", f"""{SMART}, {sql.BY_FILE}
SELECT repo, 'classic' AS mode, 'node' AS what, node_id AS id, '' AS other, node_type AS type,
  external, community FROM grouped
UNION ALL SELECT repo, 'smart', 'node', node_id, '', node_type, g.external, community
  FROM grouped g JOIN kept k USING (repo, node_id, node_type)
UNION ALL SELECT repo, 'classic', 'edge', src, dst, type, false, -1 FROM edges
UNION ALL SELECT repo, 'smart', 'edge', src, dst, type, false, -1 FROM smart""")
def export_round_trip(spark, sf_dir):
    """Both views written as an export and read back, a mode at a time."""
    path = f"{WorkTables(spark).folder}/export"
    exports.write_export(_both_views(spark, sf_dir), _metadata(spark, sf_dir), path)
    out = None
    for mode in ("classic", "smart"):
        graph, _ = exports.read_export(spark, path, mode)
        nodes = graph.nodes.select(
            "repo", F.lit("node").alias("what"), F.col("node_id").alias("id"), F.lit("").alias("other"),
            F.col("node_type").alias("type"), "external", "community",
        )
        edges = graph.edges.select(
            "repo", F.lit("edge").alias("what"), F.col("src").alias("id"), F.col("dst").alias("other"),
            "type", F.lit(False).alias("external"), F.lit(-1).alias("community"),
        )
        both = nodes.unionByName(edges).withColumn("mode", F.lit(mode))
        out = both if out is None else out.unionByName(both)
    return out


@query("pages_round_trip", f"{sql.SOURCE_GRAPH}, {sql.BY_FILE}, written AS (" + _pages_sql(
    "classic", "grouped", "edges", HIDDEN, False).lstrip().replace("wanted AS", "WITH wanted AS", 1)
    + ") SELECT repo, mode, page, md5(body) AS digest FROM written")
def pages_round_trip(spark, sf_dir):
    """Node pages written as a table and read back."""
    path = f"{WorkTables(spark).folder}/pages"
    exports.write_pages(render.node_pages(grouped(spark, sf_dir), "classic").drop("node_id"), path)
    return spark.read.parquet(path).select(
        "repo", "mode", "page", F.md5(F.col("body").cast("binary")).alias("digest")
    )


# nodes of one written graph document
DOCUMENT_NODES = 2000


@query("document_round_trip", f"""{sql.SOURCE_GRAPH}
SELECT repo, node_id AS id, '' AS other, node_type AS type, external FROM nodes
UNION ALL SELECT repo, src, dst, type, false FROM edges""")
def document_round_trip(spark, sf_dir):
    """The source graph written as JSON documents, one per file, each of a run of nodes with
    their outgoing edges, and read back as one graph per repository."""
    graph, work = scanned(spark, sf_dir).graph, WorkTables(spark)
    placed = dense_index(graph.nodes.select("repo", "node_id", "node_type", "external"), ["repo"], ["node_id"], "at", work)
    placed = work.keep(placed.withColumn("part", F.floor(F.col("at") / DOCUMENT_NODES)), "placed")
    nodes = placed.groupBy("repo", "part").agg(
        F.collect_list(F.struct(F.col("node_id").alias("id"), F.col("node_type").alias("type"), "external")).alias("nodes")
    )
    edges = graph.edges.join(
        placed.select("repo", F.col("node_id").alias("src"), "part"), ["repo", "src"]
    ).groupBy("repo", "part").agg(
        F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "type")).alias("edges")
    )
    document = F.to_json(F.struct("nodes", "edges", F.struct(F.col("repo").alias("project")).alias("metadata")))
    path = f"{work.folder}/documents"
    nodes.join(edges, ["repo", "part"], "left").select(
        F.concat_ws("-", F.sha1("repo"), "part").alias("document"), document.alias("value")
    ).write.partitionBy("document").text(path)
    back, _ = exports.read_documents(spark, f"{path}/*")
    return back.nodes.select(
        "repo", F.col("node_id").alias("id"), F.lit("").alias("other"), F.col("node_type").alias("type"), "external"
    ).unionByName(
        back.edges.select("repo", F.col("src").alias("id"), F.col("dst").alias("other"), "type", F.lit(False).alias("external"))
    )


def _items(files: DataFrame) -> DataFrame:
    """A user's extractor: ``item <name> of <kind>`` lines define items, ``needs <name>`` refers."""
    def rows(pattern: str, stage: int, is_ref: bool) -> DataFrame:
        found = F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
        return files.select("repo", "file_id", F.posexplode(found).alias("pos", "line")).select(
            "repo", "file_id", F.lit(stage).alias("stage"), F.col("pos").cast("long").alias("pos"),
            F.lit(is_ref).alias("is_ref"), F.lit(None).cast("string").alias("parent"),
            F.regexp_extract("line", pattern, 1).alias("name"),
            (F.lit("supplier") if is_ref else F.regexp_extract("line", pattern, 2)).alias("type"),
        )

    return rows(r"item (\w+) of (\w+)", 0, False).unionByName(rows(r"needs (\w+)", 1, True))


@query("tree_scan", """WITH lines AS (
  SELECT 'brand=' || replace(p_brand, '#', '_') AS folder, 'p' || p_partkey AS item,
    CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS kind, 's' || p_size AS need FROM part),
folders AS (SELECT DISTINCT folder FROM lines)
SELECT 'root' AS owner, folder AS node, 'folder' AS node_type, 'contains' AS type FROM folders
UNION ALL SELECT folder, 'file', 'file', 'contains' FROM folders
UNION ALL SELECT folder, item, kind, 'defines' FROM lines
UNION ALL SELECT DISTINCT folder, need, 'supplier', 'imports' FROM lines""")
def tree_scan(spark, sf_dir):
    """A source tree written out of ``part``, a folder per brand, read back and scanned with a
    user's extractor; file names, which Spark chooses, are left out."""
    work = WorkTables(spark)
    root = f"{work.folder}/tree"
    kind = F.when(F.col("p_size") > 25, "large").otherwise("small")
    sources.table(spark, sf_dir, "part").select(
        F.replace("p_brand", F.lit("#"), F.lit("_")).alias("brand"),
        F.format_string("item p%d of %s needs s%d", "p_partkey", kind, "p_size").alias("value"),
    ).repartition("brand").write.partitionBy("brand").text(root)
    with registry.registered(".txt", _items):
        listing = tree.read_listing(spark, root).filter(F.startswith("dir", F.lit("brand=")))
        scan = jobs.scan(tree.read_tree(spark, root, [".txt"]), listing=listing, work=work)
    named = scan.graph.nodes.select("repo", F.col("node_id").alias("dst"), "node_type")
    is_file = F.regexp_like("dst", F.lit("[.]txt$"))
    return scan.graph.edges.join(named, ["repo", "dst"]).select(
        F.regexp_replace("src", "/part-.*$", "").alias("owner"),
        F.when(is_file, "file").otherwise(F.regexp_replace("dst", "^.*::", "")).alias("node"),
        "node_type", "type",
    )


# ----------------------------------------------------------------------- search

WORDS = """list_filter(list_distinct(list_concat(
  regexp_extract_all(lower({id}), '[\\p{{L}}\\p{{N}}_]+'), [lower({type})])), lambda w: length(w) > 2)"""


@query("keyword_index", f"""{sql.SOURCE_GRAPH}
SELECT repo, unnest({WORDS.format(id='node_id', type='node_type')}) AS word, node_id FROM nodes""")
def keywords(spark, sf_dir):
    return keyword_index(scanned(spark, sf_dir).graph.nodes)


ASKED = """asked AS (
  SELECT DISTINCT query_id, repo, unnest(regexp_extract_all(lower(phrase), '[\\p{L}\\p{N}_]+')) AS word
  FROM (SELECT p_partkey AS query_id, p_brand AS repo,
          p_name || ' ' || p_type || ' model widget' AS phrase FROM part
        UNION ALL SELECT -1 - item_id, NULL, text || ' router' FROM benchmark)),"""


@query("keyword_search", f"""{sql.SOURCE_GRAPH}, {sql.PAIRS}, {sql.DEGREES}, {ASKED}
idx AS (SELECT repo, unnest({WORDS.format(id='node_id', type='node_type')}) AS word, node_id FROM nodes),
scored AS (SELECT a.query_id, i.repo, i.node_id, count(*) AS words_hit FROM asked a JOIN idx i
  ON i.word = a.word AND (a.repo IS NULL OR a.repo = i.repo) WHERE length(a.word) > 2 GROUP BY ALL)
SELECT query_id, repo, row_number() OVER (PARTITION BY query_id, repo
    ORDER BY words_hit DESC, degree DESC, node_id) AS rank, node_id, words_hit, degree
FROM scored JOIN degrees USING (repo, node_id) QUALIFY rank <= 10""")
def search(spark, sf_dir):
    local = sources.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("query_id"), F.col("p_brand").alias("repo"),
        F.concat_ws(" ", "p_name", "p_type", F.lit("model widget")).alias("phrase"),
    )
    anywhere = sources.table(spark, sf_dir, "benchmark").select(
        (-1 - F.col("item_id")).alias("query_id"), F.lit(None).cast("string").alias("repo"),
        F.concat("text", F.lit(" router")).alias("phrase"),
    )
    return keyword_search(local.unionByName(anywhere), scanned(spark, sf_dir).graph, 10)
