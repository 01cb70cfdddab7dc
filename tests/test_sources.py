"""Source trees, exports, whole jobs and user extractors."""

import json

import pytest
from pyspark.sql import functions as F

import codeloom
from codeloom.operators import metrics, registry
from codeloom.operators.facts import explode_facts, fact
from codeloom.plans import jobs
from codeloom.sources import exports, tree


@pytest.fixture()
def project(tmp_path):
    root = tmp_path / "shop"
    files = {
        "main.py": b"import os\n\nclass App:\n    def run(self):\n        pass\n",
        "src/util.ts": b"export function helperFn() {\n  return 1;\n}\n",
        "src/app.TS": b"import { h } from './util';\nexport const go = () => 1;\r\n",
        "src/deep/latin.go": b"// caf\xe9\nfunc Lat(x int) {\n}\n",
        "docs/read me.txt": b"nothing",
        "node_modules/x/skip.js": b"function no() {}\n",
        "src/build/skip.py": b"def no(): pass\n",
    }
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    return root


def scan_project(spark, root, **options):
    files = tree.read_tree(spark, str(root), registry.extensions())
    listing = tree.read_listing(spark, str(root))
    return jobs.scan(files, listing=listing, **options)


def test_read_tree(spark, project):
    listing = tree.read_listing(spark, str(project))
    assert {(r.repo, r.file_id, r.ext) for r in listing.collect()} >= {
        ("shop", "main.py", ".py"), ("shop", "docs/read me.txt", ".txt"),
        ("shop", "src/app.TS", ".ts"),
    }
    files = tree.read_tree(spark, str(project), registry.extensions())
    text = {r.file_id: r.content for r in files.collect()}
    assert "docs/read me.txt" not in text
    assert text["src/deep/latin.go"].startswith("// café")
    assert text["src/app.TS"].endswith("=> 1;\n")


def test_pruned_and_unfocused_files_are_not_opened(spark, project):
    """A file over the size limit fails the read as soon as it is opened."""
    (project / "node_modules/x/big.js").write_bytes(b"x" * 5000)
    (project / "other").mkdir()
    (project / "other/big.js").write_bytes(b"x" * 5000)
    (project / "other/notes.bin").write_bytes(b"x" * 5000)
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "2000")
    try:
        files = tree.read_tree(spark, str(project), registry.extensions(), focus="src")
        assert {r.file_id for r in files.collect()} == {"src/util.ts", "src/app.TS", "src/deep/latin.go"}
        with pytest.raises(Exception, match="(?i)max"):
            tree.read_tree(spark, str(project), registry.extensions()).collect()
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)


def test_roots_that_are_not_spelt_canonically(spark, project):
    listed = {r.file_id for r in tree.read_listing(spark, str(project)).collect()}
    for root in (f"{project}/../{project.name}", f"{project}/", f"file://{project}", f"{project}/src/.."):
        assert {r.file_id for r in tree.read_listing(spark, root).collect()} == listed
        files = tree.read_tree(spark, root, registry.extensions())
        assert {r.repo for r in files.collect()} == {project.name}


def test_names_with_spaces_and_signs(spark, project):
    (project / "a b+c").mkdir()
    (project / "a b+c/é %41.py").write_bytes(b"def f(): pass\n")
    files = tree.read_tree(spark, str(project), registry.extensions(), focus="a b+c")
    assert [r.file_id for r in files.collect()] == ["a b+c/é %41.py"]


def test_many_projects(spark, project):
    rows = tree.read_listing(spark, str(project.parent), many=True).collect()
    assert {r.repo for r in rows} == {"shop"}
    assert "src/util.ts" in {r.file_id for r in rows}


def test_scan_of_a_tree(spark, project):
    graph = scan_project(spark, project).graph
    nodes = {r.node_id: r.node_type for r in graph.nodes.collect()}
    assert nodes["root"] == "folder" and nodes["docs"] == "folder"
    assert nodes["main.py::run"] == "function" and nodes["src/deep/latin.go::Lat"] == "function"
    assert not any("skip" in n or "node_modules" in n for n in nodes)
    edges = {(r.src, r.dst, r.type) for r in graph.edges.collect()}
    assert ("src/app.TS", "src/util.ts", "imports") in edges
    assert ("root", "main.py", "contains") in edges and ("root", "src", "contains") in edges


def test_focus(spark, project):
    graph = scan_project(spark, project, focus="src").graph
    nodes = {r.node_id for r in graph.nodes.collect()}
    assert "src" in nodes and "root" not in nodes and "main.py" not in nodes
    assert all(r.src != "root" for r in graph.edges.collect())


def test_export_round_trip(spark, project, tmp_path):
    scanned = scan_project(spark, project)
    views, metadata = codeloom.export(scanned, top=3)
    out = str(tmp_path / "export")
    for fmt in ("parquet", "json"):
        codeloom.write_export(views, metadata, f"{out}-{fmt}", fmt)
        for mode in ("classic", "smart"):
            graph, meta = codeloom.read_export(spark, f"{out}-{fmt}", mode, fmt)
            want = views[mode]
            keys = ["repo", "node_id", "node_type", "external", "community"]
            assert set(graph.nodes.select(keys).collect()) == set(want.nodes.select(keys).collect())
            assert set(graph.edges.collect()) == set(
                want.edges.select("repo", "src", "dst", "type").collect()
            )
            row = meta.first()
            assert row.total_nodes == want.nodes.count() and row.project == "shop"
            assert row.parser_info["py"].method == "python-ast"
    pages = jobs.pages(views, metadata)
    codeloom.write_pages(pages, f"{out}-pages")
    back = spark.read.parquet(f"{out}-pages")
    assert set(back.select("repo", "mode", "page", "body").collect()) == set(
        pages.select("repo", "mode", "page", "body").collect()
    )
    assert back.filter("page = 'INDEX'").count() == 2


def test_read_documents_with_defaults(spark, tmp_path):
    doc = {
        "nodes": [{"id": "a", "type": "file", "community": 2, "external": False},
                  {"id": "b"}, {"id": "a", "type": "late"}],
        "edges": [{"source": "a", "target": "b"}],
        "metadata": {},
    }
    path = tmp_path / "shop_mapping_classic.json"
    path.write_text(json.dumps(doc, indent=2))
    graph, meta = codeloom.read_documents(spark, str(path))
    nodes = {r.node_id: (r.repo, r.node_type, r.external, r.community)
             for r in graph.nodes.collect()}
    assert nodes == {"a": ("shop", "late", False, -1), "b": ("shop", "unknown", False, -1)}
    assert graph.edges.first().type == "related"
    row = meta.first()
    assert (row.project, row.total_nodes, row.scan_date) == ("shop", 2, "N/A")
    page = codeloom.pages({"classic": graph}, meta).filter("page = 'a'").first()
    assert page.body.startswith("# a\n\ntype:: late\n\n## → Outgoing\n**Related:**\n- [[b]]")


def test_user_extractor_wins_and_can_be_python(spark):
    files = tree.files_from_table(
        spark.createDataFrame(
            [("r", "x\\a.sql", "CREATE TABLE t1\r\n")], "repo string, path string, content string"
        )
    )
    assert files.first().file_id == "x/a.sql" and files.first().content.endswith("t1\n")
    before = dict(registry._EXTRACTORS)

    def tables(files):
        names = F.regexp_extract_all("content", F.lit(r"TABLE (\w+)"), F.lit(1))
        return explode_facts(files, F.transform(names, lambda n, i: fact(0, i, n, F.lit("table"))))

    def nothing(files):
        return tables(files).filter("false")

    try:
        codeloom.register_extractor(".SQL", nothing)
        codeloom.register_extractor([".sql"], tables)
        assert registry.extractor_for(".Sql").table is tables
        assert registry.extractor_for_path("p/q.sql").table is tables
        assert registry.extractor_for_path(".sql") is None
        nodes = {r.node_id: r.node_type for r in jobs.scan(files).graph.nodes.collect()}
        assert nodes["x/a.sql::t1"] == "table"
    finally:
        registry._EXTRACTORS.clear()
        registry._EXTRACTORS.update(before)


def test_documents_with_repeated_edges_and_names_with_spaces(spark, tmp_path):
    graph = {
        "nodes": [{"id": i, "type": "file"} for i in ("a", "b", "c")],
        "edges": [{"source": "a", "target": t, "type": "imports"} for t in ("b", "b", "c", "b")],
    }
    (tmp_path / "my shop+é_mapping_classic.json").write_text(json.dumps(graph))
    read, metadata = exports.read_documents(spark, str(tmp_path))
    assert [r.project for r in metadata.collect()] == ["my shop+é"]
    listed = metrics.capped_neighbours(metrics.adjacency(read.edges), cap=2)
    assert {(r.node_id, r.direction): r.neighbours for r in listed.collect()} == {
        ("a", "out"): ["b", "c"], ("b", "in"): ["a"], ("c", "in"): ["a"],
    }
