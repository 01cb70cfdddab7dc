"""Folder and file structure: tables cut from the file listing alone.

Only ``repo``, ``file_id``, ``dir``, ``name`` and ``ext`` are read here, so a
columnar file table never has its text touched by these operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.names import classify_file

ROOT = "root"


def prune_dirs(files: DataFrame) -> DataFrame:
    """Drop files below a directory of an ignored name."""
    return files.filter(~below_ignored(F.col("dir")))


def below_ignored(directory: Column) -> Column:
    ignored = F.array(*[F.lit(d) for d in fixed.IGNORED_DIRS])
    return F.arrays_overlap(F.split(directory, "/"), ignored)


def in_focus(file_id: Column, focus: str) -> Column:
    return F.startswith(file_id, F.lit(focus.strip("/") + "/"))


def focus_files(files: DataFrame, focus: str | None) -> DataFrame:
    if not focus:
        return files
    return files.filter(in_focus(F.col("file_id"), focus))


def supported_files(files: DataFrame, extensions) -> DataFrame:
    return files.filter(F.col("ext").isin(*extensions))


def _folder_id(directory):
    return F.when(directory == "", ROOT).otherwise(directory)


def folder_paths(listing: DataFrame, focus: str | None = None) -> DataFrame:
    """(repo, folder, parent): every directory of the listing and its ancestors
    up to the top or the focus; the parent of the topmost is null."""
    top = focus.strip("/") if focus else ""
    parts = F.split("dir", "/")
    prefixes = F.when(
        F.col("dir") != "",
        F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))
    # one row per directory first: files outnumber directories
    dirs = listing.select("repo", "dir").distinct()
    paths = dirs.select(
        "repo", F.explode(F.concat(F.array(F.lit("")), prefixes)).alias("path")
    ).distinct()
    if top:
        paths = paths.filter(
            (F.col("path") == top) | F.startswith("path", F.lit(top + "/"))
        )
    cut = F.length("path") - F.length(F.substring_index("path", "/", -1)) - 1
    parent = F.substr("path", F.lit(1), F.greatest(cut, F.lit(0)))
    return paths.select(
        "repo",
        _folder_id(F.col("path")).alias("folder"),
        F.when(F.col("path") != top, _folder_id(parent)).alias("parent"),
    )


def file_nodes(files: DataFrame) -> DataFrame:
    return files.select(
        "repo",
        F.col("file_id").alias("node_id"),
        classify_file(F.col("name")).alias("node_type"),
        _folder_id(F.col("dir")).alias("folder"),
    )


def module_map(files: DataFrame) -> DataFrame:
    """(repo, module, file_id): dotted names of Python files, last file wins.

    Two ids can share a dotted name (``a.b.py`` and ``a/b.py``); the order of a
    file table being none, "last" is the greatest id.
    """
    dotted = F.replace("file_id", F.lit("/"), F.lit("."))
    cut = F.length(F.substring_index(dotted, ".py", -1)) + 3
    module = F.when(
        F.contains(dotted, F.lit(".py")),
        F.substr(dotted, F.lit(1), F.length(dotted) - cut),
    ).otherwise(dotted)
    return (
        files.filter(F.col("ext") == ".py")
        .groupBy("repo", module.alias("module"))
        .agg(F.max("file_id").alias("file_id"))
    )


def suffix_index(files: DataFrame) -> DataFrame:
    """(repo, suffix, file_id): every trailing sub-path of every file id."""
    parts = F.split("file_id", "/")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"),
    )
    return files.select("repo", F.explode(suffixes).alias("suffix"), "file_id")
