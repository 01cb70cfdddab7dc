"""Python files, read by their syntax tree.

Only text that does not parse comes back from the Arrow batches, to be read by
pattern in the same stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .facts import FACT_TYPE
from .python_source import loose_facts, tree_facts

_FIELDS = ("stage", "pos", "is_ref", "parent", "name", "type")


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [tree_facts(t or "") for t in batch["content"]]
        unread = [f is None for f in found]
        yield pd.DataFrame(
            {
                "repo": batch["repo"], "file_id": batch["file_id"],
                "found": [[dict(zip(_FIELDS, row)) for row in f or []] for f in found],
                "content": batch["content"].where(pd.Series(unread, index=batch.index), None),
            }
        )


def python_found(files: DataFrame) -> DataFrame:
    """(repo, file_id, found, parsed) of Python files."""
    read = files.select("repo", "file_id", "content").mapInPandas(
        _read_batches, f"repo string, file_id string, found array<{FACT_TYPE}>, content string"
    )
    loose = loose_facts(F.col("content")).cast(f"array<{FACT_TYPE}>")
    parsed = F.col("content").isNull()
    return read.select(
        "repo", "file_id", F.when(parsed, F.col("found")).otherwise(loose).alias("found"),
        parsed.alias("parsed"),
    )


def python_facts(files: DataFrame) -> DataFrame:
    return (
        python_found(files)
        .select("repo", "file_id", F.explode("found").alias("f"))
        .select("repo", "file_id", "f.*")
    )
