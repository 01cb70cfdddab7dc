"""Python files: syntax tree where it parses, patterns where it does not."""

from __future__ import annotations

import ast
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import find_all
from .facts import fact


def _type_of(node: ast.AST) -> str:
    if isinstance(node, ast.AsyncFunctionDef):
        return "async_function"
    if isinstance(node, ast.ClassDef):
        bases = {b.id for b in node.bases if isinstance(b, ast.Name)}
        return "class" if bases.isdisjoint(fixed.PYDANTIC_BASES) else "pydantic_model"
    lowered = node.name.lower()
    bare = {d.id for d in node.decorator_list if isinstance(d, ast.Name)}
    if "task" in lowered or "task" in bare:
        return "celery_task"
    dotted = {d.attr for d in node.decorator_list if isinstance(d, ast.Attribute)}
    if not dotted.isdisjoint(fixed.FASTAPI_VERBS):
        return "fastapi_endpoint"
    return "test" if lowered.startswith("test_") else "function"


def _definitions(text: str) -> list[tuple[str, str]] | None:
    """(name, type) of each class and function in source order, or None where
    the text is not valid Python.  The explicit stack keeps deep nesting safe."""
    try:
        stack = [ast.parse(text)]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    found = []
    while stack:
        node = stack.pop()
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            found.append((node.name, _type_of(node)))
        stack.extend(reversed(list(ast.iter_child_nodes(node))))
    return found


def tree_facts(text: str) -> list[tuple] | None:
    """Facts of a file in the order of its tree; None where it does not parse."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = _definitions(text)
    return None if found is None else [(0, i, False, None, n, t) for i, (n, t) in enumerate(found)]


def loose_facts(text: Column) -> Column:
    """The pattern reading: upper-case classes, defs without leading underscore."""
    classes = F.filter(
        find_all(text, fixed.PYTHON_LOOSE_CLASS),
        lambda n: F.regexp_like(n, F.lit(r"^\p{IsUppercase}")),
    )
    functions = F.filter(
        find_all(text, fixed.PYTHON_LOOSE_DEF), lambda n: ~F.startswith(n, F.lit("_"))
    )
    return F.concat(
        F.transform(classes, lambda n, i: fact(0, i, n, F.lit("class"))),
        F.transform(
            functions,
            lambda n, i: fact(
                1,
                i,
                n,
                F.when(F.contains(F.lower(n), F.lit("task")), "celery_task").otherwise(
                    "function"
                ),
            ),
        ),
    )
