"""Which extractor reads which file extension.

The rule-based languages are array expressions evaluated in one scan of the file
table; Python, and JavaScript with TypeScript, take a filtered scan of their own
through Arrow batches.  Users add their own with ``register_extractor``; the last registration of an
extension wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from . import javascript, javascript_source, parsed, rules
from .facts import FACT_TYPE, FACTS_SCHEMA, explode_facts, no_facts


@dataclass(frozen=True)
class Extractor:
    """``expression`` builds an array of facts over the columns of a file; ``table``
    maps a table of files to a table of facts.  Exactly one is set."""

    method: str
    expression: Callable[[], Column] | None = None
    table: Callable[[DataFrame], DataFrame] | None = None


_EXTRACTORS: dict[str, Extractor] = {}


def register_extractor(
    extensions, extract: Callable[[DataFrame], DataFrame], method: str = "custom"
) -> None:
    """``extract`` maps files (repo, file_id, dir, name, ext, content) to facts
    (see ``facts``); ``mapInPandas`` is open to it."""
    for ext in [extensions] if isinstance(extensions, str) else extensions:
        _EXTRACTORS[ext.lower()] = Extractor(method, table=extract)


@contextmanager
def registered(
    extensions, extract: Callable[[DataFrame], DataFrame], method: str = "custom"
) -> Iterator[None]:
    """``register_extractor`` for the jobs run inside; earlier registrations are back
    afterwards."""
    before = dict(_EXTRACTORS)
    register_extractor(extensions, extract, method)
    try:
        yield
    finally:
        _EXTRACTORS.clear()
        _EXTRACTORS.update(before)


def _register(extensions, extractor: Extractor) -> None:
    for ext in extensions:
        _EXTRACTORS[ext] = extractor


def _register_defaults() -> None:
    for language, (extensions, _) in rules.LANGUAGES.items():
        _register(
            extensions,
            Extractor(
                "regex",
                expression=lambda language=language: rules.language_facts(
                    language, F.col("content")
                ),
            ),
        )
    _register(fixed.JS_EXTENSIONS, Extractor("tokens", table=javascript_source.script_facts))
    _register(fixed.PYTHON_EXTENSIONS, Extractor("python-ast", table=parsed.python_facts))


def js_rule_extractor(files: DataFrame) -> DataFrame:
    """The pattern-only reading of JavaScript and TypeScript, to be registered
    in place of the token reading where that is wanted."""
    return explode_facts(
        files, javascript.js_rule_facts(files["content"], files["ext"], files["dir"])
    )


def extensions() -> list[str]:
    return sorted(_EXTRACTORS)


def extractor_for(ext: str) -> Extractor | None:
    return _EXTRACTORS.get(ext.lower())


def extractor_for_path(path: str) -> Extractor | None:
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    stem, dot, suffix = name.lstrip(".").rpartition(".")
    return extractor_for(dot + suffix) if stem and suffix else None


def methods() -> dict[str, str]:
    return {ext: e.method for ext, e in _EXTRACTORS.items()}


def extract_facts(files: DataFrame) -> DataFrame:
    """Facts of every supported file."""
    by_expression: dict[str, Extractor] = {}
    by_table: dict[Callable, list[str]] = {}
    for ext, extractor in _EXTRACTORS.items():
        if extractor.expression is not None:
            by_expression[ext] = extractor
        else:
            by_table.setdefault(extractor.table, []).append(ext)
    tables = [
        extract(files.filter(F.col("ext").isin(*exts))) for extract, exts in by_table.items()
    ]
    if by_expression:
        tables.append(_native_facts(files, by_expression))
    columns = [f.split()[0] for f in FACTS_SCHEMA.split(", ")]
    return reduce(DataFrame.unionByName, [t.select(*columns) for t in tables])


def _native_facts(files: DataFrame, extractors: dict[str, Extractor]) -> DataFrame:
    """One scan for all languages: each file meets its own language's rules."""
    scanned = files.filter(F.col("ext").isin(*extractors))
    session = files.sparkSession.sparkContext.applicationId
    return explode_facts(scanned, _by_extension(session, tuple(extractors.items())))


@lru_cache(maxsize=4)
def _by_extension(session: str, extractors: tuple[tuple[str, Extractor], ...]) -> Column:
    """Building some hundred expressions takes longer than planning with them, so
    the column is kept for the life of the session."""
    grouped: dict[int, tuple[Extractor, list[str]]] = {}
    for ext, extractor in extractors:
        grouped.setdefault(id(extractor), (extractor, []))[1].append(ext)
    found = None
    for extractor, exts in grouped.values():
        test = F.col("ext").isin(*exts)
        facts = extractor.expression().cast(f"array<{FACT_TYPE}>")
        found = F.when(test, facts) if found is None else found.when(test, facts)
    return found.otherwise(no_facts())


_register_defaults()
