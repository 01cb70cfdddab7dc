"""Where imports lead: alias resolution and routing of JavaScript imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.names import normalise_id
from ..functions.work import WorkTables, shuffled
from .javascript import relative_path
from .structure import suffix_index


def _leading_paths(path):
    """The first 1, 2, ... segments of a path, joined."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )


def _spellings(requests: DataFrame) -> DataFrame:
    """(repo, alias, rank, suffix): each alias with the endings to be tried."""
    tried = F.array(
        *[F.concat(normalise_id(F.col("alias")), F.lit(s)) for s in fixed.ALIAS_SUFFIXES]
    )
    return (
        requests.select("repo", "alias").distinct()
        .select("repo", "alias", F.posexplode(tried).alias("rank", "suffix"))
    )


def files_at(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, alias, placed): the file that lies at the very path, by the first
    spelling that has one."""
    listed = files.select("repo", F.col("file_id").alias("suffix"))
    return (
        _spellings(requests).join(shuffled(listed), ["repo", "suffix"])
        .groupBy("repo", "alias").agg(F.min_by("suffix", "rank").alias("placed"))
    )


def resolve_aliases(
    requests: DataFrame, files: DataFrame, work: WorkTables | None = None
) -> DataFrame:
    """(repo, file_id, alias) -> the same with ``target``, for those that resolve.

    The eight spellings of an alias are tried in order against the trailing
    sub-paths of all files; the first spelling with a hit wins.  Of several
    hits the one sharing most leading segments with the importing file is
    taken, then the smallest id.

    Hits are never paired with requests one by one.  A spelling with one hit is
    settled by the aggregate; for the others the best hit is looked up by
    (spelling, leading path), longest path first, in an index that holds one
    row per such key.  Cost is linear in requests and files whatever the number
    of files called ``index.ts``.  What requests are joined with is written first:
    both sides of such a join are then plain shuffles, whose hot keys (an alias that
    every file imports) adaptive execution splits.
    """
    work = (work or WorkTables(requests.sparkSession)).child()
    requests = requests.select("repo", "file_id", "alias").distinct()
    spellings = _spellings(requests)
    # only files of a wanted base name are worth indexing
    last = F.substring_index("suffix", "/", -1).alias("last")
    wanted = spellings.select("repo", last).distinct()
    listed = files.select(
        "repo", "file_id", F.substring_index("file_id", "/", -1).alias("last")
    ).join(wanted, ["repo", "last"], "left_semi")
    index = suffix_index(listed)
    hits = index.groupBy("repo", "suffix").agg(
        F.count("*").alias("hits"), F.min("file_id").alias("first")
    )
    best = (
        spellings.join(hits, ["repo", "suffix"])
        .groupBy("repo", "alias")
        .agg(F.min(F.struct("rank", "suffix", "hits", "first")).alias("best"))
        .select("repo", "alias", "best.suffix", "best.hits", "best.first")
    )
    settled = requests.join(work.keep(best, "best"), ["repo", "alias"])
    single = settled.filter("hits = 1").select(
        "repo", "file_id", "alias", F.col("first").alias("target")
    )

    several = settled.filter("hits > 1").select(
        "repo",
        "file_id",
        "alias",
        "suffix",
        "first",
        F.posexplode(_leading_paths("file_id")).alias("shared", "lead"),
    )
    crowded = hits.filter("hits > 1").select("repo", "suffix")
    by_lead = (
        index.join(crowded, ["repo", "suffix"], "left_semi")
        .select("repo", "suffix", F.explode(_leading_paths("file_id")).alias("lead"), "file_id")
        .groupBy("repo", "suffix", "lead")
        .agg(F.min("file_id").alias("hit"))
    )
    nearest = (
        several.join(work.keep(by_lead, "by-lead"), ["repo", "suffix", "lead"], "left")
        .groupBy("repo", "file_id", "alias")
        .agg(
            F.coalesce(
                F.max(
                    F.when(F.col("hit").isNotNull(), F.struct("shared", "hit"))
                )["hit"],
                F.min("first"),
            ).alias("target")
        )
    )
    return single.unionByName(nearest)


def _internal_path(raw):
    return reduce(
        Column.__or__, [F.startswith(raw, F.lit(p)) for p in fixed.INTERNAL_PREFIXES]
    )


def _without_marks(raw):
    for mark in fixed.ALIAS_MARKS:
        raw = F.replace(raw, F.lit(mark), F.lit(""))
    return raw


def route_js_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Raw paths of kind ``js`` -> their targets: a file (``resolved``), an
    internal ``alias``, or an external ``npm_package``.

    Relative paths are first worked out against the importing file's folder, and
    name the file at that place before any other that ends alike.
    """
    raw = F.col("raw")
    wanted = imports.filter(
        (raw != "")
        & ~raw.isin(*fixed.JS_NOISE)
        & ~F.startswith(raw, F.lit("node:"))
    )
    packages = (
        wanted.filter(~_internal_path(raw))
        .withColumn("raw", F.substring_index(F.substring_index("raw", "/", 1), "@", 1))
        .withColumn("kind", F.lit("npm_package"))
        .filter("raw != ''")
    )

    depth = F.length("file_id") - F.length(F.substring_index("file_id", "/", -1)) - 1
    folder = F.substr("file_id", F.lit(1), F.greatest(depth, F.lit(0)))
    cleaned = wanted.filter(_internal_path(raw)).withColumn("raw", _without_marks(raw))
    dotted = F.startswith("raw", F.lit("./")) | F.startswith("raw", F.lit("../"))
    looked_up = cleaned.withColumn(
        "alias", F.when(dotted, relative_path(F.col("raw"), folder)).otherwise(F.col("raw"))
    )
    looked_up = looked_up.withColumn("dotted", dotted)
    work = WorkTables(imports.sparkSession)
    placed = work.keep(files_at(looked_up.filter("dotted"), files), "placed")
    found = resolve_aliases(looked_up, files, work)
    internal = (
        looked_up.join(found, ["repo", "file_id", "alias"], "left")
        .join(placed, ["repo", "alias"], "left")
        .withColumn("target", F.coalesce(F.when(F.col("dotted"), F.col("placed")), "target"))
        .withColumn("kind", F.when(F.col("target").isNull(), "alias").otherwise("resolved"))
        .withColumn("raw", F.coalesce("target", "raw"))
        .filter("raw != ''")
    )
    return packages.select(*imports.columns).unionByName(internal.select(*imports.columns))


def route_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """All imports with their final targets."""
    direct = imports.filter((F.col("kind") != "js") & (F.col("raw") != ""))
    return direct.unionByName(route_js_imports(imports.filter("kind = 'js'"), files))
