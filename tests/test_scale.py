"""What must not grow with the input: tables broadcast, joins computed again."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codeloom.functions import work as w
from codeloom.functions.work import WorkTables
from codeloom.operators import communities as c
from codeloom.operators import graph as g
from codeloom.operators import iterate, metrics
from codeloom.operators.graph import Graph
from codeloom.operators.iterate import index_graph, salted_edges, send
from codeloom.plans import jobs
from workload import queries, sources


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(spark):
    work = WorkTables(spark)
    nodes = spark.createDataFrame(
        [("r", f"n{i}", "class", i % 3 == 0) for i in range(30)],
        "repo string, node_id string, node_type string, external boolean",
    )
    edges = spark.createDataFrame(
        [("r", f"n{i}", f"n{i * 2}", "imports") for i in range(1, 30)],
        "repo string, src string, dst string, type string",
    )
    return work.keep(nodes, "nodes"), work.keep(edges, "edges")


def test_nodes_are_not_broadcast(spark, written):
    nodes, edges = written
    for df in (
        g.known_ids(edges.select("repo", F.col("dst").alias("node_id")), nodes),
        g.dangling_targets(nodes, edges),
        g.without_types(g.Graph(nodes, edges), ("class",)).edges,
        metrics.internal_sources(edges, nodes),
    ):
        assert "Broadcast" not in _plan(df)
    missing = g.dangling_targets(nodes, edges).select("node_id").collect()
    assert {r[0] for r in missing} == {f"n{i}" for i in range(30, 60, 2)}


def test_rounds_do_not_broadcast_the_nodes(spark):
    work = WorkTables(spark)
    edges = work.keep(spark.createDataFrame([(i, (i + 1) % 20) for i in range(20)], "src long, dst long"), "e")
    spread, sources_ = salted_edges(edges)
    state = work.keep(sources_.select(F.col("src").alias("vid"), "n_salts"), "state")
    sent = send(spread, state, F.col("vid").alias("payload"))
    assert not re.search(r"BroadcastHashJoin \[[^]]*salt", _plan(sent))
    assert {tuple(r) for r in sent.select("dst", "payload").collect()} == {((i + 1) % 20, i) for i in range(20)}
    spread.unpersist()


def test_line_items_are_joined_once(spark, tmp_path, monkeypatch):
    rows = {
        "region": ("r_regionkey int, r_name string", [(0, "EU"), (1, "US")]),
        "nation": ("n_nationkey int, n_regionkey int", [(0, 0), (1, 1)]),
        "customer": ("c_custkey long, c_nationkey int", [(1, 0), (2, 1), (None, 1)]),
        "orders": ("o_orderkey long, o_custkey long", [(1, 1), (2, 2), (2, 2), (None, 1)]),
        "lineitem": (
            "l_orderkey long, l_partkey long, l_suppkey long",
            [(1, 5, 6), (1, 5, 6), (2, 5, None), (2, None, 6), (None, 7, 7)],
        ),
    }
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    given, real = [], sources.build_graph

    def build(nodes, edges, work):
        given.extend([nodes, edges])
        return real(nodes, edges, work)

    monkeypatch.setattr(sources, "build_graph", build)
    found = sources.fk_graph(spark, str(tmp_path))
    assert not any("lineitem" in path for df in given for path in df.inputFiles())
    parts = given[0].filter("external").select("repo", "node_id").filter("node_id is not null")
    assert sorted(map(tuple, parts.collect())) == [
        ("EU", "part/5"), ("EU", "supplier/6"), ("US", "part/5"), ("US", "supplier/6"),
    ]
    edges = found.edges.filter("type = 'imports'").select("repo", "src", "dst").collect()
    assert sorted(map(tuple, edges)) == [
        ("EU", "order/1", "part/5"), ("EU", "order/1", "supplier/6"),
        ("US", "order/2", "part/5"), ("US", "order/2", "supplier/6"),
    ]


def test_tasks_of_degrees_grow_with_the_edges(spark, written, monkeypatch):
    nodes, edges = written
    monkeypatch.setattr(w, "ROWS_PER_TASK", 2)
    again = edges.withColumn("type", F.lit("uses"))
    twice = edges.unionByName(edges).unionByName(again).unionByName(
        spark.createDataFrame([(None, "a", "b", None)] * 2, edges.schema)
    )
    kept = g.distinct_edges(twice, 60)
    assert kept.rdd.getNumPartitions() == 30
    assert kept.count() == 2 * 29 + 1
    graph = g.Graph(nodes, kept, 59)
    assert g.pairs_of(graph).rdd.getNumPartitions() == 30
    assert g.pairs_of(graph).count() == 29 + 1
    plain = metrics.degrees(g.Graph(nodes, kept)).collect()
    assert sorted(map(str, metrics.degrees(graph).collect())) == sorted(map(str, plain))


def test_lists_are_dealt_out_and_hubs_cut_first(spark, monkeypatch):
    rows = [("r", f"n{i % 40}", "out", "t", f"m{i}") for i in range(300)]
    rows += [("r", "hub", "in", "t", f"m{i % 150}") for i in range(300)]
    rows += [(None, "n", "in", None, "a"), (None, "n", "in", None, "a"), ("r", "n", "in", "t", None)]
    lists = spark.createDataFrame(
        rows, "repo string, node_id string, direction string, type string, neighbour string"
    )
    expected = {}
    for *key, other in rows:
        expected.setdefault(tuple(key), set()).update([other] if other else [])
    monkeypatch.setattr(metrics, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(metrics, "SAMPLED", 1)
    monkeypatch.setattr(w, "ROWS_PER_TASK", 50)
    got = metrics.capped_neighbours(lists, 5, rows=len(rows))
    assert "REPARTITION_BY_NUM" in _plan(got)
    found = got.collect()
    assert len(found) == len(expected)
    assert {tuple(r)[:4]: r.neighbours for r in found} == {k: sorted(v)[:5] for k, v in expected.items()}


def test_pairs_are_distinct_as_numbers(spark, written):
    nodes, edges = written
    twice = edges.unionByName(edges.withColumn("type", F.lit("uses")))
    assert index_graph(nodes, twice, WorkTables(spark)).pairs.count() == 29


def test_known_targets_are_not_looked_up(spark, monkeypatch):
    files = spark.createDataFrame(
        [("r", "a/x.js", "a", "x.js", ".js", "import pad from 'leftpad';\nclass Big {\n}\n"),
         (None, "b/y.js", "b", "y.js", ".js", "import pad from 'leftpad';\n")],
        "repo string, file_id string, dir string, name string, ext string, content string",
    )
    asked, real = [], g.dangling_targets

    def looked_up(nodes, edges, rows):
        asked.append(edges)
        return real(nodes, edges, rows)

    monkeypatch.setattr(g, "dangling_targets", looked_up)
    scan = jobs.scan(files)
    assert {(r.repo, r.type) for r in asked[0].collect()} == {("r", "imports"), (None, "contains")}
    missing = real(scan.graph.nodes.filter("seq.class <> 3"), scan.graph.edges)
    assert set(missing.collect()) == set(scan.graph.nodes.filter("seq.class = 3").select(missing.columns).collect())


def test_smart_view_is_written_once(spark):
    sf = "/root/testdata/sf0.001"
    view = queries._both_views(spark, sf)["smart"]
    assert queries._both_views(spark, sf)["smart"] is view
    assert all("smart-edges" in path for path in view.edges.inputFiles())
    assert view.n_edges == view.edges.count()


def test_scan_works_its_file_table_out_once_for_paths(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = [("r", f"d{i % 3}/f{i}.js", f"d{i % 3}", f"f{i}.js", ".js", "import x from './f0';\n") for i in range(20)]
    schema = "repo string, file_id string, dir string, name string, ext string, content string"
    files = spark.createDataFrame(rows, schema).mapInPandas(counted, schema)
    scan = jobs.scan(files)
    assert scan.imports.count() == 20
    # the paths, and the text by rules, by tokens and by syntax tree
    assert read.value <= 4 * len(rows)


def test_facts_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(g, "BROADCAST_ROWS", 2)
    numbers = spark.createDataFrame([("r", f"f{i}", i) for i in range(5)], "repo string, file_id string, file long")
    facts = spark.createDataFrame([("r", "f1", "x"), ("r", "f4", "y")], "repo string, file_id string, name string")
    placed = g.with_place(facts, (numbers, 5))
    assert "Broadcast" not in _plan(placed)
    assert {(r.name, r.file) for r in placed.collect()} == {("x", 1), ("y", 4)}


def test_listing_is_spread_before_it_is_worked_out(spark):
    listing = sources.with_alias(spark, "/root/testdata/sf0.001")
    plan = _plan(listing)
    assert plan.index("Generate") < plan.index("Exchange RoundRobinPartitioning")


def _linked(spark, pairs, work, **more):
    """Nodes as ``_move_round`` takes them, and their edges in both directions."""
    both = [(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs]
    edges = work.keep(spark.createDataFrame(both, "src bigint, dst bigint, w double"), "edges")
    state = edges.groupBy(F.col("src").alias("vid")).agg(F.sum("w").alias("k"), F.count("*").alias("links"))
    values = {"rid": "0L", "place": "vid", "loops": "0D", "m2": f"{len(both)}D", "few": "1D",
              "round": "0", "comm": "vid"}
    return work.keep(state.selectExpr("*", *[f"{v} AS {c}" for c, v in values.items()]), "state"), edges


def test_a_round_of_few_nodes_runs_in_one_task(spark):
    work = w.WorkTables(spark)
    state, edges = _linked(spark, [(i, (i * 7 + 1) % 50) for i in range(50)], work)
    laid = iterate.lay(edges, edges.groupBy("src").agg(F.count("*").alias("out_edges")), 0, 150)
    plan = _plan(c._move_round(state, laid, 42, 50, True, work))
    assert "hashpartitioning" not in plan
    # the number of the round is no part of the code, which is compiled once
    assert re.search(r"xxhash64\([^,]*place[^,]*, [^,]*round", plan)


def test_a_round_of_many_nodes_leaves_the_edges_in_place(spark, monkeypatch):
    monkeypatch.setattr(iterate, "FEW_ROWS", 10)
    work = w.WorkTables(spark)
    state, edges = _linked(spark, [(i, (i * 7 + 1) % 50) for i in range(50)], work)
    laid = iterate.lay(edges, edges.groupBy("src").agg(F.count("*").alias("out_edges")), 0, 150)
    laid.plain.count()
    plan = _plan(c._move_round(state, laid, 42, 50, True, work)).split("InMemoryRelation")[0]
    assert "Exchange hashpartitioning(src" not in plan
    assert len(re.findall(r"Exchange hashpartitioning\((?:vid|dst)", plan)) <= 3


@pytest.fixture(scope="module")
def linked(spark):
    """A graph of three repositories, and its communities."""
    rng = random.Random(11)
    nodes, edges = [], []
    for repo, size, links in (("a", 24, 40), ("b", 14, 18), ("d", 3, 0)):
        nodes += [(repo, f"n{i:02}", "file", False) for i in range(size)]
        pairs = {tuple(sorted(rng.sample(range(size), 2))) for _ in range(links)}
        pairs |= {(0, i) for i in range(1, size, 3)} if links else set()
        edges += [(repo, f"n{x:02}", f"n{y:02}", "imports") for x, y in sorted(pairs)]
    graph = Graph(
        spark.createDataFrame(nodes, "repo string, node_id string, node_type string, external boolean"),
        spark.createDataFrame(edges, "repo string, src string, dst string, type string"),
    )
    return graph, c.communities(graph)


@pytest.mark.parametrize("few, broadcast, salt, repos", [
    (0, 200_000, 100_000, 1000),  # dealt out, totals broadcast
    (0, 2, 3, 0),  # totals joined in two parts, hubs, tables of repositories
    (10**6, 2, 3, 1000),  # hubs in one task
    (60, 200_000, 100_000, 0),  # dealt out first, one task later
])
def test_communities_are_the_same_however_rows_lie(
    spark, monkeypatch, linked, few, broadcast, salt, repos
):
    graph, usual = linked
    usual = sorted(map(tuple, usual.collect()))
    assert len({r[2] for r in usual if r[0] == "a"}) > 1
    monkeypatch.setattr(iterate, "FEW_ROWS", few)
    monkeypatch.setattr(c, "FEW_ROWS", few)
    monkeypatch.setattr(c, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(iterate, "EDGES_PER_SALT", salt)
    monkeypatch.setattr(c, "FEW_REPOS", repos)
    assert sorted(map(tuple, c.communities(graph).collect())) == usual


def test_few_nodes_are_written_once_a_round(spark, monkeypatch, linked):
    """The old rounds wrote totals, moves and the repositories that go on: three tables."""
    names = []
    plain = w.written
    monkeypatch.setattr(w, "written", lambda df, path: names.append(path.rsplit("/", 1)[1]) or plain(df, path))
    c.communities(linked[0])
    assert any("moves" in n for n in names)
    assert not any(x in n for n in names for x in ("totals", "going", "at-rest"))
