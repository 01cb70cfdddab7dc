"""What every extractor yields: one row per definition or reference found.

``facts`` is the row form both contracts are cut from, so that the files are
scanned once:

    facts    repo, file_id, stage INT, pos BIGINT, is_ref BOOLEAN, parent, name, type
    symbols  repo, file_id, stage, pos, parent_id, node_id, node_type
    imports  repo, file_id, stage, pos, raw, kind

Facts may carry the ``file`` number of their file (``graph.number_paths``), which symbols
and imports then have as well.

``parent`` is null for a member of the file itself, else the name of the owner.
For a reference ``type`` says what becomes of the target (see ``graph``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import find_all

FACT_TYPE = (
    "struct<stage:int,pos:bigint,is_ref:boolean,parent:string,name:string,type:string>"
)
FACTS_SCHEMA = (
    "repo string, file_id string, stage int, pos bigint, is_ref boolean, "
    "parent string, name string, type string"
)


def fact(
    stage: int, pos: Column, name: Column, node_type: Column, *, is_ref: bool = False,
    parent: Column | None = None,
) -> Column:
    owner = F.lit(None).cast("string") if parent is None else parent
    return F.struct(
        F.lit(stage).alias("stage"),
        pos.cast("bigint").alias("pos"),
        F.lit(is_ref).alias("is_ref"),
        owner.alias("parent"),
        name.alias("name"),
        node_type.alias("type"),
    )


def no_facts() -> Column:
    return F.array().cast(f"array<{FACT_TYPE}>")


@dataclass(frozen=True)
class Rule:
    """One pattern of a rule-based language.

    ``target`` maps the array of matched texts (references only); ``exclude``
    lists names that are not definitions; ``unless_seen`` keeps only names no
    earlier rule of the file has defined.
    """

    pattern: str
    type: str
    is_ref: bool = False
    exclude: tuple[str, ...] = ()
    target: Callable[[Column], Column] | None = None
    unless_seen: bool = False


def rule_facts(rules: list[Rule], text: Column) -> Column:
    """All facts of a file under a rule table, as one array expression."""
    arrays, seen = [], []
    for stage, rule in enumerate(rules):
        found = find_all(text, rule.pattern)
        if rule.exclude:
            found = F.filter(found, lambda n: ~n.isin(*rule.exclude))
        if rule.target is not None:
            found = rule.target(found)
        if rule.unless_seen:
            found = F.array_except(found, F.concat(*seen))
        if not rule.is_ref:
            seen.append(found)
        arrays.append(
            F.transform(
                found,
                lambda n, i: fact(
                    stage, i, n, F.lit(rule.type), is_ref=rule.is_ref
                ),
            )
        )
    return F.concat(*arrays)


def explode_facts(files: DataFrame, found: Column) -> DataFrame:
    """The facts of each file as rows; the text goes no further than this."""
    return files.select("repo", "file_id", F.explode(found).alias("f")).select(
        "repo", "file_id", "f.stage", "f.pos", "f.is_ref", "f.parent", "f.name", "f.type"
    )


def _place(table: DataFrame) -> list[str]:
    return ["file"] if "file" in table.columns else []


def symbols_of(facts: DataFrame) -> DataFrame:
    owner = F.when(F.col("parent").isNull(), F.col("file_id")).otherwise(
        F.concat_ws("::", "file_id", "parent")
    )
    return facts.filter(~F.col("is_ref")).select(
        "repo",
        "file_id",
        "stage",
        "pos",
        owner.alias("parent_id"),
        F.concat_ws("::", "file_id", "name").alias("node_id"),
        F.col("type").alias("node_type"),
        *_place(facts),
    )


def imports_of(facts: DataFrame) -> DataFrame:
    return facts.filter("is_ref").select(
        "repo",
        "file_id",
        "stage",
        "pos",
        F.col("name").alias("raw"),
        F.col("type").alias("kind"),
        *_place(facts),
    )
