"""Graph semantics on small tables written out by hand."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.functions import work as work_module
from codeloom.functions.work import WorkTables, dense_index, work_folder
from codeloom.operators import graph as g
from codeloom.operators import iterate, metrics, render, resolve, smart
from codeloom.operators.communities import communities, modularity
from codeloom.operators.graph import Graph
from codeloom.operators.pagerank import pagerank
from codeloom.operators.search import keyword_search

NODE = "repo string, node_id string, node_type string, external boolean"
EDGE = "repo string, src string, dst string, type string"


def nodes_of(spark, *rows):
    return spark.createDataFrame([("r", *row) for row in rows], NODE)


def edges_of(spark, *rows):
    return spark.createDataFrame([("r", *row) for row in rows], EDGE)


def plain_graph(spark, ids, pairs, node_type="file"):
    return Graph(
        nodes_of(spark, *[(i, node_type, False) for i in ids]),
        edges_of(spark, *[(a, b, "imports") for a, b in pairs]),
    )


def test_first_type_stays(spark):
    rows = spark.createDataFrame(
        [("r", "x", "module", True, 2, 1), ("r", "x", "header", True, 2, 0),
         ("r", "a\\b", "file", False, 0, 3), ("r", "a/b", "proto", True, 2, 2),
         ("r", "tie", "b", False, 1, 5), ("r", "tie", "a", True, 1, 5), ("r", "tie", "a", False, 1, 5),
         ("r", "none", None, True, 1, 5), (None, "x", "far", False, 3, 10**12 - 1)],
        NODE + ", class int, file bigint",
    ).withColumn(
        "seq",
        F.struct("class", "file", F.lit(7).alias("stage"), F.lit(10**11 - 1).cast("bigint").alias("pos")),
    )
    found = g.first_wins(rows)
    got = {(r.repo, r.node_id): (r.node_type, r.external, *r.seq) for r in found.collect()}
    assert got == {
        ("r", "x"): ("header", True, 2, 0, 7, 10**11 - 1), ("r", "a/b"): ("file", False, 0, 3, 7, 10**11 - 1),
        ("r", "tie"): ("a", False, 1, 5, 7, 10**11 - 1), ("r", "none"): (None, True, 1, 5, 7, 10**11 - 1),
        (None, "x"): ("far", False, 3, 10**12 - 1, 7, 10**11 - 1),
    }
    plan = found._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_edges_are_cleaned(spark):
    edges = g.distinct_edges(
        edges_of(spark, ("a", "b", "x"), ("a", "b", "x"), ("a", "b", "y"), ("a", "a", "x"),
                 ("", "b", "x"), ("a", "", "x"), (None, "b", "x"), ("a\\c", "b", "x"))
    )
    got = {(r.src, r.dst, r.type) for r in edges.collect()}
    assert got == {("a", "b", "x"), ("a", "b", "y"), ("a/c", "b", "x")}


def test_dangling_targets_become_external(spark):
    graph = g.build_graph(
        nodes_of(spark, ("a", "file", False)), edges_of(spark, ("a", "b", "x"), ("q", "a", "x"))
    )
    got = {(r.node_id, r.node_type, r.external) for r in graph.nodes.collect()}
    assert got == {("a", "file", False), ("b", "unresolved", True)}


def test_degree_counts_ordered_pairs(spark):
    graph = Graph(
        nodes_of(spark, ("a", "file", False), ("b", "file", False), ("c", "file", False)),
        edges_of(spark, ("a", "b", "x"), ("a", "b", "y"), ("b", "a", "x"), ("ghost", "a", "x")),
    )
    got = {r.node_id: r.degree for r in metrics.degrees(graph).collect()}
    assert got == {"a": 3, "b": 2, "c": 0, "ghost": 1}


def test_god_nodes_skip_folders_and_break_ties_by_id(spark):
    graph = Graph(
        nodes_of(spark, ("d", "folder", False), ("b", "file", False), ("a", "file", False),
                 ("m", "module", True)),
        edges_of(spark, ("d", "a", "x"), ("d", "b", "x"), ("a", "m", "x"), ("b", "m", "x")),
    )
    got = [(r.external, r.rank, r.node_id, r.degree)
           for r in metrics.god_nodes(graph, 1).orderBy("external").collect()]
    assert got == [(False, 1, "a", 2), (True, 1, "m", 2)]


def test_type_edges_drop_builtins(spark):
    refs = spark.createDataFrame(
        [("r", "f", t, "param_type") for t in ("int", "None", "", "Order")],
        "repo string, func string, type_name string, kind string",
    )
    assert [r.dst for r in g.type_edges(refs).collect()] == ["Order"]


# ------------------------------------------------------------ alias resolution


def resolved(spark, files, asked):
    table = spark.createDataFrame([("r", f) for f in files], "repo string, file_id string")
    asked = spark.createDataFrame(
        [("r", f, a) for f, a in asked], "repo string, file_id string, alias string"
    )
    return {
        (r.file_id, r.alias): r.target for r in resolve.resolve_aliases(asked, table).collect()
    }


def test_spelling_order_beats_nearness(spark):
    got = resolved(
        spark,
        ["a/x.js", "b/x.ts", "a/y/index.ts", "a/y.jsx", "q/z"],
        [("a/m.ts", "x"), ("a/m.ts", "y"), ("a/m.ts", "z"), ("a/m.ts", "none")],
    )
    assert got == {("a/m.ts", "x"): "b/x.ts", ("a/m.ts", "y"): "a/y.jsx", ("a/m.ts", "z"): "q/z"}


def test_nearest_of_many_hits(spark):
    files = ["a/b/u.ts", "a/c/u.ts", "d/u.ts", "a/b/m/u.ts"]
    got = resolved(
        spark, files,
        [("a/c/k.ts", "u"), ("a/b/m/k.ts", "u"), ("zz/k.ts", "u"), ("a/b/u.ts", "u")],
    )
    assert got == {
        ("a/c/k.ts", "u"): "a/c/u.ts",
        ("a/b/m/k.ts", "u"): "a/b/m/u.ts",
        ("zz/k.ts", "u"): "a/b/m/u.ts",  # nothing shared: the smallest id
        ("a/b/u.ts", "u"): "a/b/u.ts",
    }


def brute_alias(files, file_id, alias):
    tails = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]
    for tail in tails:
        want = alias + tail
        hits = sorted(f for f in files if f == want or f.endswith("/" + want))
        if hits:
            def shared(hit):
                n = 0
                for a, b in zip(file_id.split("/"), hit.split("/")):
                    if a != b:
                        break
                    n += 1
                return n
            return max(hits, key=lambda h: (shared(h), [-ord(c) for c in h]))
    return None


def test_alias_against_brute_force(spark):
    rng = np.random.default_rng(7)
    names = ["u.ts", "u.js", "v.tsx", "index.ts", "w/index.js"]
    files = sorted({
        "/".join([*rng.choice(list("abc"), rng.integers(0, 4)), names[rng.integers(len(names))]])
        for _ in range(80)
    })
    aliases = ["u", "v", "w", "a/u", "b/index", "index.ts", "c/w", "nope"]
    asked = [(f, a) for f in files for a in aliases]
    got = resolved(spark, files, asked)
    for file_id, alias in asked:
        assert got.get((file_id, alias)) == brute_alias(files, file_id, alias)


def test_import_routing(spark):
    files = spark.createDataFrame(
        [("r", f) for f in ("src/app/m.ts", "src/app/util.ts", "src/lib/index.ts", "top.ts")],
        "repo string, file_id string",
    )
    raws = ["./util", "../lib", "@/lib", "@scope/pkg", "react/dom", "node:fs", "console", "",
            "pkg@1/x", "~/none", "../../top"]
    imports = spark.createDataFrame(
        [("r", "src/app/m.ts", 1, i, raw, "js") for i, raw in enumerate(raws)],
        "repo string, file_id string, stage int, pos bigint, raw string, kind string",
    )
    got = {(r.pos, r.raw, r.kind) for r in resolve.route_imports(imports, files).collect()}
    assert got == {
        (0, "src/app/util.ts", "resolved"), (1, "src/lib/index.ts", "resolved"),
        (2, "src/lib/index.ts", "resolved"), (3, "@scope/pkg", "alias"),
        (4, "react", "npm_package"), (8, "pkg", "npm_package"), (9, "none", "alias"),
        (10, "top.ts", "resolved"),
    }


# --------------------------------------------------------------------- PageRank


def power_iteration(ids, pairs, alpha=0.85, tol=1e-6, rounds=100, fixed=None):
    n, at = len(ids), {v: i for i, v in enumerate(ids)}
    pairs = sorted(set(pairs))
    out = np.zeros(n)
    for a, _ in pairs:
        out[at[a]] += 1
    x = np.full(n, 1 / n)
    for _ in range(fixed or rounds):
        y = np.zeros(n)
        for a, b in pairs:
            y[at[b]] += alpha * x[at[a]] / out[at[a]]
        y += (alpha * x[out == 0].sum() + 1 - alpha) / n
        change, x = np.abs(y - x).sum(), y
        if fixed is None and change < n * tol:
            return dict(zip(ids, x))
    return dict(zip(ids, x if fixed else np.ones(n)))


CASES = {
    "cycle": (list("abcd"), [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]),
    "dangling": (list("abcde"), [("a", "b"), ("a", "c"), ("b", "c"), ("d", "c")]),
    "alone": (["z"], []),
}


def test_pagerank_per_repository(spark):
    nodes = spark.createDataFrame(
        [(repo, v, "file", False) for repo, (ids, _) in CASES.items() for v in ids], NODE
    )
    edges = spark.createDataFrame(
        [(repo, a, b, t) for repo, (_, pairs) in CASES.items() for a, b in pairs for t in "xy"],
        EDGE,
    )
    got = {}
    for r in pagerank(Graph(nodes, edges), tolerance=1e-2).collect():
        got.setdefault(r.repo, {})[r.node_id] = r["rank"]
    for repo, (ids, pairs) in CASES.items():
        assert got[repo] == pytest.approx(power_iteration(ids, pairs, tol=1e-2), abs=1e-12)
        assert sum(got[repo].values()) == pytest.approx(1)


def test_pagerank_with_salted_hubs(spark, monkeypatch):
    monkeypatch.setattr(iterate, "EDGES_PER_SALT", 2)
    ids = ["hub", *[f"n{i}" for i in range(9)]]
    pairs = [("hub", v) for v in ids[1:]] + [(v, "hub") for v in ids[1:4]]
    found = pagerank(plain_graph(spark, ids, pairs), rounds=4).collect()
    got = {r.node_id: r["rank"] for r in found}
    assert got == pytest.approx(power_iteration(ids, pairs, fixed=4), abs=1e-12)


def test_pagerank_failure_gives_one(spark):
    ids, pairs = CASES["cycle"]
    found = pagerank(plain_graph(spark, ids, pairs), max_rounds=2).collect()
    assert {r["rank"] for r in found} == {1.0}


def test_pagerank_counts_ends_that_are_no_nodes(spark):
    found = pagerank(plain_graph(spark, ["a"], [("ghost", "a")]), rounds=3).collect()
    got = {r.node_id: r["rank"] for r in found}
    assert got == pytest.approx(power_iteration(["a", "ghost"], [("ghost", "a")], fixed=3))


# ------------------------------------------------------------------ smart graph


def test_keep_rules(spark):
    cases = [
        # id, type, external, rank, kept
        ("react", "npm_package", True, 1.0, False),
        ("src", "folder", False, 0.0, True),
        ("a.py", "file", False, 0.0, True),
        ("t.py", "test", False, 1.0, False),
        ("alias", "alias", False, 1.0, False),
        ("a.py::ab", "class", False, 1.0, False),
        ("a.py::_abc", "class", False, 1.0, False),
        ("a.py::TestX", "class", False, 1.0, False),
        ("a.py::Log", "class", False, 1.0, False),
        ("a.py::Order", "class", False, 2e-6, True),
        ("a.py::Order2", "class", False, 1e-6, False),
        ("a.py::func", "function", False, 2e-6, True),
        ("a.py::meth", "method", False, 1e-5, False),
        ("a.py::meth2", "method", False, 2e-5, True),
        ("a.py::x::yes", "class", False, 1.0, True),
        ("a.py::norank", "class", False, None, False),
    ]
    nodes = nodes_of(spark, *[(i, t, e) for i, t, e, _, _ in cases])
    ranks = spark.createDataFrame(
        [("r", i, r) for i, _, _, r, _ in cases if r is not None],
        "repo string, node_id string, rank double",
    )
    got = {r.node_id for r in smart.smart_nodes(nodes, ranks).collect()}
    assert got == {i for i, *_, kept in cases if kept}


def test_rewiring(spark):
    edges = edges_of(
        spark,
        ("A", "B", "imports"),  # kept -> kept
        ("A", "x", "imports"), ("x", "C", "defines"),  # detour, both types
        ("x", "A", "calls"),  # back: a self-loop stays
        ("y", "z", "imports"),  # both dropped
        ("x", "y", "imports"), ("y", "B", "imports"),  # two hops are not bridged
    )
    kept = nodes_of(spark, *[(i, "file", False) for i in "ABC"])
    got = {(r.src, r.dst, r.type) for r in smart.smart_edges(edges, kept).collect()}
    assert got == {
        ("A", "B", "imports"),
        ("A", "C", "imports"), ("A", "C", "defines"),
        ("A", "A", "imports"), ("A", "A", "calls"),
    }


def test_relative_import_names_the_file_at_its_place(spark):
    ids = ["src/main.js", "src/util.js", "packages/x/src/util.ts", "packages/x/src/far.ts"]
    files = spark.createDataFrame([("r", i) for i in ids], "repo string, file_id string")
    imports = spark.createDataFrame(
        [("r", "src/main.js", 1, i, raw, "js") for i, raw in enumerate(("./util", "./far", "../gone"))],
        "repo string, file_id string, stage int, pos bigint, raw string, kind string",
    )
    routed = resolve.route_js_imports(imports, files).orderBy("pos").collect()
    assert [(r.raw, r.kind) for r in routed] == [
        ("src/util.js", "resolved"), ("packages/x/src/far.ts", "resolved"), ("../gone", "alias"),
    ]


# ------------------------------------------------------------------ communities


def cliques(sizes, bridge=True):
    ids, pairs, groups = [], [], []
    for c, size in enumerate(sizes):
        members = [f"c{c}n{i:02d}" for i in range(size)]
        pairs += [(a, b) for i, a in enumerate(members) for b in members[i + 1:]]
        if bridge and c:
            pairs.append((groups[-1][0], members[0]))
        groups.append(members)
        ids += members
    return ids, pairs, groups


def test_planted_communities_are_found(spark):
    ids, pairs, groups = cliques([6, 7, 8, 5])
    graph = plain_graph(spark, ids + ["lone"], pairs)
    found = {r.node_id: r.community for r in communities(graph).collect()}
    for members in groups:
        assert len({found[m] for m in members}) == 1
    # ids count up in the order of each community's smallest member
    assert [found[m[0]] for m in groups] == [0, 1, 2, 3]
    assert found["lone"] == 4


def test_communities_do_not_depend_on_partitioning(spark):
    ids, pairs, _ = cliques([5, 5, 6, 9, 4])
    graph = plain_graph(spark, ids, pairs)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    try:
        for n in ("3", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.add(frozenset((r.node_id, r.community) for r in communities(graph).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_modularity_beats_simple_partitions(spark):
    rng = np.random.default_rng(3)
    ids = [f"n{i:02d}" for i in range(40)]
    pairs = {(ids[a], ids[b]) for a, b in rng.integers(0, 40, (110, 2)) if a < b}
    graph = plain_graph(spark, ids, sorted(pairs))
    links = g.undirected(graph.edges)
    found = communities(graph)

    def quality(labels):
        row = modularity(labels, links).first()
        return row["modularity"]

    single = found.withColumn("community", F.xxhash64("node_id"))
    together = found.withColumn("community", F.lit(0))
    assert quality(found) > max(quality(single), quality(together)) + 0.2


def test_a_repository_has_the_same_communities_beside_others(spark):
    """Neither another repository's size nor its place in the order counts."""
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(90)})
    edges = [("m", f"n{a:02}", f"n{b:02}", "imports") for a, b in pairs]
    nodes = [("m", f"n{i:02}", "file") for i in range(40)]
    one = [("a", "alone", "file")]
    many = [("z", f"x{i}", "file") for i in range(600)]
    many_edges = [("z", f"x{i}", f"x{(i * 7 + 1) % 600}", "imports") for i in range(600)]

    def labels(nodes, edges):
        rows = [(*n, False) for n in nodes]
        graph = Graph(spark.createDataFrame(rows, NODE), spark.createDataFrame(edges, EDGE))
        return {r.node_id: r.community for r in communities(graph).filter("repo = 'm'").collect()}

    alone = labels(nodes, edges)
    assert len(set(alone.values())) > 1
    assert labels(one + nodes, edges) == alone
    assert labels(nodes + many, edges + many_edges) == alone


def test_excluded_types_have_no_community(spark):
    graph = Graph(
        nodes_of(spark, ("d", "folder", False), ("a", "file", False), ("u", "unresolved", True)),
        edges_of(spark, ("d", "a", "contains"), ("a", "u", "imports")),
    )
    got = {r.node_id: r.community for r in communities(graph).collect()}
    assert got == {"d": -1, "u": -1, "a": 0}


def test_dense_index_spreads_one_group(spark):
    df = spark.range(5000).select(
        F.lit("r").alias("repo"), F.lpad(F.col("id").cast("string"), 5, "0").alias("v")
    ).repartition(7)
    rows = dense_index(df, ["repo"], ["v"], "i", WorkTables(spark)).collect()
    assert all(int(r.v) == r.i for r in rows) and len(rows) == 5000


# ------------------------------------------------------- pages, search, folders


def test_pages_collide_and_the_last_wins(spark):
    nodes = nodes_of(spark, ("a/b", "file", False), ("a:b", "file", False))
    graph = g.build_graph(nodes, edges_of(spark))
    rows = render.node_pages(graph).collect()
    assert [(r.page, r.node_id) for r in rows] == [("a_b", "a:b")]


def test_page_lists_are_capped_and_sorted(spark):
    nodes = nodes_of(spark, ("hub", "file", False), ("ext", "module", True),
                     *[(f"n{i:02d}", "file", False) for i in range(30)])
    edges = edges_of(spark, *[("hub", f"n{i:02d}", "zeta kind") for i in range(30)],
                     ("hub", "n00", "alpha"), ("ext", "hub", "imports"))
    body = {r.node_id: r.body for r in render.node_pages(g.build_graph(nodes, edges)).collect()}
    lines = body["hub"].split("\n")
    assert lines[:7] == ["# hub", "", "type:: file", "", "## → Outgoing", "**Alpha:**", "- [[n00]]"]
    assert lines[7] == "**Zeta kind:**" and lines[8:-1] == [f"- [[n{i:02d}]]" for i in range(25)]
    assert lines[-1] == "" and "Incoming" not in body["hub"]
    assert "ext" not in body


def test_classic_pages_hide_private_symbols(spark):
    nodes = nodes_of(spark, ("f::_x", "function", False), ("f::y", "function", False),
                     ("f::ok", "function", False))
    graph = g.build_graph(nodes, edges_of(spark))
    assert {r.node_id for r in render.node_pages(graph, "classic").collect()} == {"f::ok"}
    assert render.node_pages(graph, "smart").count() == 3


def test_search_order(spark):
    graph = plain_graph(spark, ["user/order", "user", "order", "a"], [("a", "user"), ("a", "order")])
    asked = spark.createDataFrame(
        [(1, "r", "User ORDER user"), (2, None, "order of"), (3, "other", "user")],
        "query_id bigint, repo string, phrase string",
    )
    rows = keyword_search(asked, graph, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.node_id, r.words_hit) for r in rows] == [
        (1, 1, "user/order", 2), (1, 2, "order", 1), (2, 1, "order", 1), (2, 2, "user/order", 1),
    ]


# ------------------------------------------------------------------ work tables


def session_like(setting, master):
    conf = SimpleNamespace(get=lambda key, default: setting or default)
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_work_folder_follows_the_session():
    assert work_folder(session_like("s3://shared/cp/", "yarn")).startswith("s3://shared/cp/codeloom-")
    with pytest.raises(RuntimeError):
        work_folder(session_like(None, "yarn"))


def test_large_sides_are_not_broadcast(spark):
    small = spark.range(10)
    assert work_module.small_side(small, work_module.BROADCAST_ROWS + 1) is small
