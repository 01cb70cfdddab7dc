"""Source trees as file tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import decoded_path, file_extension
from ..functions.text import decode_text
from ..operators.structure import below_ignored, in_focus


def _any_case_glob(extensions) -> str:
    spelled = [
        "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)
        for ext in extensions
    ]
    return "*{" + ",".join(spelled) + "}"


def split_path(repo: Column, file_id: Column) -> list[Column]:
    """The columns of a file table that follow from its id."""
    name = F.substring_index(file_id, "/", -1)
    length = F.length(file_id) - F.length(name) - 1
    return [
        repo.alias("repo"),
        file_id.alias("file_id"),
        F.substr(file_id, F.lit(1), F.greatest(length, F.lit(0))).alias("dir"),
        name.alias("name"),
        file_extension(name).alias("ext"),
    ]


def _canonical(spark: SparkSession, root: str) -> str:
    """The root as the file system spells it in the paths of its files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString().rstrip("/")


def _place(path: Column, base: str, many: bool) -> tuple[Column, Column]:
    """(repo, file_id) of a path below the root: one project, or with ``many`` one
    project per first-level folder."""
    below = F.startswith(path, F.lit(f"{base}/"))
    inside = F.when(below, F.substr(path, F.lit(len(base) + 2))).otherwise(
        F.raise_error(F.concat(F.lit(f"not below {base}: "), path))
    )
    if not many:
        return F.lit(base.rsplit("/", 1)[-1]), inside
    repo = F.substring_index(inside, "/", 1)
    return repo, F.substr(inside, F.length(repo) + 2)


def _tree(
    spark: SparkSession, root: str, many: bool, focus: str | None, glob: str | None, every: bool
) -> DataFrame:
    """Files below a root with ``path``, ``repo`` and ``file_id``.

    Without ``every``, files of ignored folders and outside the focus are dropped by
    their path alone: the filter is on file metadata, which Spark applies to its list
    of files, so those are not opened.
    """
    base = _canonical(spark, root)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(base)
    if not every:
        # a local path has three slashes here and one in ``path``
        known = F.regexp_replace(
            decoded_path(raw.metadataColumn("_metadata")["file_path"]), "^file:///", "file:/"
        )
        _, file_id = _place(known, base, many)
        folder = F.regexp_replace(file_id, "/?[^/]*$", "")
        kept = ~below_ignored(folder)
        raw = raw.filter(kept & in_focus(file_id, focus) if focus else kept)
    repo, file_id = _place(F.col("path"), base, many)
    if many:  # files beside the projects belong to none
        raw = raw.filter(F.contains(F.substr(F.col("path"), F.lit(len(base) + 2)), F.lit("/")))
    return raw.select("*", *split_path(repo, file_id))


def read_listing(spark: SparkSession, root: str, many: bool = False) -> DataFrame:
    """(repo, file_id, dir, name, ext) of every file; no file is opened.

    Spark lists the tree on the driver and in a listing job; for very many millions of
    files keep them as a table and use ``files_from_table``.
    """
    listed = _tree(spark, root, many, None, None, every=True)
    return listed.select("repo", "file_id", "dir", "name", "ext")


def read_tree(
    spark: SparkSession, root: str, extensions, many: bool = False, focus: str | None = None
) -> DataFrame:
    """A file table with decoded text of the files with these extensions.

    Files of other extensions, below ignored folders or outside the focus are never
    opened.
    """
    files = _tree(spark, root, many, focus, _any_case_glob(extensions), every=False)
    return files.select(
        "repo", "file_id", "dir", "name", "ext", decode_text(F.col("content")).alias("content")
    )


def files_from_table(
    table: DataFrame, repo: str = "repo", path: str = "path", content: str = "content"
) -> DataFrame:
    """A file table from any table of paths and texts (bytes or strings)."""
    binary = dict(table.dtypes)[content] == "binary"
    text = decode_text(F.col(content)) if binary else F.regexp_replace(
        F.coalesce(content, F.lit("")), r"\r\n?", "\n"
    )
    file_id = F.translate(F.col(path), "\\", "/")
    return table.select(*split_path(F.col(repo), file_id), text.alias("content"))
