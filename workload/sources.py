"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.names import file_extension
from codeloom.functions.work import WorkTables, shuffled
from codeloom.operators.graph import Graph, build_graph

from .templates import JS_FAMILY, KINDS, LANGUAGES, TEMPLATES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _turn() -> Column:
    """How often the languages have come round, so that cases within a language vary."""
    return F.floor(F.col("k") / len(LANGUAGES))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    lang = _pick(LANGUAGES, k % len(LANGUAGES))
    stem = F.concat(
        _pick(KINDS, F.col("p_size") % len(KINDS)), F.lit("_"), (F.col("p_size") % 2).cast("string")
    )
    alias = F.concat(
        _pick(KINDS, (F.col("p_size") + 3) % len(KINDS)),
        F.lit("_"),
        (F.col("p_size") % 2).cast("string"),
    )
    middle = (
        F.when(k % 29 == 0, "build")
        .when(k % 31 == 0, "node_modules")
        .when(k % 37 == 0, ".dist-info")
        .otherwise(F.substring_index("p_name", " ", 1))
    )
    directory = F.when(k % 41 == 0, "").otherwise(
        F.concat(F.lower("p_type"), F.lit("/"), middle, F.lit("/m"), k.cast("string"))
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("repo"), F.col("p_partkey").alias("k"), "p_name", "p_type", "p_size"
    )
    # a few bytes per part, in few files, grow into paths and texts: spread them before they do
    parts = parts.repartition(spark.sparkContext.defaultParallelism)
    return parts.select(
        "repo", "k", lang.alias("lang"), stem.alias("stem"), alias.alias("alias"),
        directory.alias("dir"),
    )


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three files per part: repo, k, alias, kind, dir, name, file_id, ext."""
    parts = _parts(spark, sf_dir)
    k, lang, turn = F.col("k"), F.col("lang"), _turn()
    suffix = _pick([t.ext for t in LANGUAGES.values()], k % len(LANGUAGES))
    suffix = F.when((lang == "go") & (k % 5 == 0), ".GO").otherwise(suffix)
    keyed = (F.col("dir") == "") | (lang == "proto")
    twin = (lang == "js") & (F.col("dir") != "") & (turn % 4 == 1)
    base = F.concat("stem", F.when(keyed, F.concat(F.lit("_"), k.cast("string"))).otherwise(""))

    def file(kind: Column, directory: Column, name: Column, when: Column | None = None) -> Column:
        row = F.struct(kind.alias("kind"), directory.alias("dir"), name.alias("name"))
        return row if when is None else F.when(when, row)

    files = F.array(
        file(lang, F.col("dir"), F.concat(base, suffix)),
        file(F.lit("helper"), F.col("dir"),
             F.when(twin, "helper.js").otherwise(F.lit("helper.ts")),
             lang.isin(*JS_FAMILY) & (F.col("dir") != "")),
        # a spelling that is tried earlier ends a longer path in another folder
        file(F.lit("helper"), F.concat(F.lit("packages/"), "dir"), F.lit("helper.ts"), twin),
        file(F.lit("pystub"), F.lit(""), F.concat(base, F.lit("_pb2_grpc.py")),
             (lang == "proto") & (turn % 2 == 0)),
        file(F.lit("gostub"), F.lit(""), F.concat(base, F.lit(".pb.go")),
             (lang == "proto") & (turn % 4 == 0)),
    )
    file_id = F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat_ws("/", "dir", "name"))
    return (
        parts.select("repo", "k", "alias", F.explode(F.array_compact(files)).alias("f"))
        .select("repo", "k", "alias", "f.*")
        .withColumn("file_id", file_id)
        .withColumn("ext", file_extension(F.col("name")))
    )


def with_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, file_id, alias): each file and another file's stem."""
    return _listing(spark, sf_dir).select("repo", "file_id", "alias")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, file_id, dir, name, ext, content), texts filled in from templates."""
    k = F.col("k")
    text = None
    for kind, template in TEMPLATES.items():
        body = F.lit(template.text)
        if template.more:
            body = F.concat(body, F.when(_turn() % 3 == 0, template.more).otherwise(""))
        test = F.col("kind") == kind
        text = F.when(test, body) if text is None else text.when(test, body)
    content = F.replace(
        F.replace(text, F.lit("{k}"), k.cast("string")), F.lit("{alias}"), F.col("alias")
    )
    return _listing(spark, sf_dir).select("repo", "file_id", "dir", "name", "ext", content.alias("content"))


def fk_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Region, nation, customer and order contain each other; orders import the
    parts and suppliers of their line items.  ``repo`` is the customer's region.

    Line items meet their orders once, as numbers, in tables that are written; the node
    side gets each part and supplier of a region once."""
    work = WorkTables(spark)
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")

    def node(kind: str, key: str) -> Column:
        return F.concat(F.lit(kind + "/"), F.col(key).cast("string"))

    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    placed = work.keep(
        orders.select("o_orderkey", "o_custkey").join(
            buyers.select("c_custkey", "r_name"), F.col("o_custkey") == F.col("c_custkey")
        ),
        "placed-orders",
    )
    lines = work.keep(
        items.join(
            shuffled(placed.select("o_orderkey", "r_name")),
            F.col("l_orderkey") == F.col("o_orderkey"),
        ).select("r_name", "o_orderkey", "l_partkey", "l_suppkey"),
        "placed-lines",
    )
    repo = F.col("r_name").alias("repo")

    def edges(df, src, dst, kind):
        return df.select(repo, src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))

    order = node("order", "o_orderkey")
    all_edges = (
        edges(places, node("region", "r_regionkey"), node("nation", "n_nationkey"), "contains")
        .unionByName(
            edges(buyers, node("nation", "n_nationkey"), node("customer", "c_custkey"), "contains")
        )
        .unionByName(edges(placed, node("customer", "c_custkey"), order, "contains"))
        .unionByName(edges(lines, order, node("part", "l_partkey"), "imports"))
        .unionByName(edges(lines, order, node("supplier", "l_suppkey"), "imports"))
    )

    def nodes(df, node_id, kind, external=False):
        return df.select(
            repo, node_id.alias("node_id"), F.lit(kind).alias("node_type"),
            F.lit(external).alias("external"),
        )

    def used(key):
        return work.keep(lines.select("r_name", key).distinct(), f"used-{key}")

    all_nodes = (
        nodes(region, node("region", "r_regionkey"), "folder")
        .unionByName(nodes(places, node("nation", "n_nationkey"), "folder"))
        .unionByName(nodes(buyers, node("customer", "c_custkey"), "class"))
        .unionByName(nodes(placed, order, "function"))
        .unionByName(nodes(used("l_partkey"), node("part", "l_partkey"), "module", True))
        .unionByName(nodes(used("l_suppkey"), node("supplier", "l_suppkey"), "module", True))
    )
    return build_graph(all_nodes, all_edges, work)


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User -> key by event type, reversed for errors and sign-ups; a repository
    per day."""
    user = F.concat(F.lit("user/"), F.col("user_id").cast("string"))
    key = F.concat(F.lit("k/"), F.get_json_object("props", "$.k"))
    back = F.col("event_type").isin("error", "signup")
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("repo"),
        F.when(back, key).otherwise(user).alias("src"),
        F.when(back, user).otherwise(key).alias("dst"),
        F.col("event_type").alias("type"),
    )


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users are the given nodes; keys appear as unresolved targets."""
    edges = event_edges(spark, sf_dir)
    users = edges.select(
        "repo", F.explode(F.array("src", "dst")).alias("node_id")
    ).filter(F.startswith("node_id", F.lit("user/")))
    return build_graph(
        users.select(
            "repo", "node_id", F.lit("class").alias("node_type"), F.lit(False).alias("external")
        ),
        edges,
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, src, dst, type): page URL without scheme, query and fragment to
    every link target on the page; the repository is the host."""
    bare = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", "")
    return (
        table(spark, sf_dir, "pages")
        .select(
            F.substring_index(bare, "/", 1).alias("repo"),
            bare.alias("src"),
            F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst"),
        )
        .withColumn("type", F.lit("imports"))
    )
