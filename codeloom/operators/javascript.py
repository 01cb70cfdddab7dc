"""The pattern-only reading of JavaScript and TypeScript, and relative import paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import bind, find_all, first_chars, java_regex, match_contexts, mentioned
from .facts import fact


def _like(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(java_regex(pattern)))


def _is_hook(name: Column) -> Column:
    return F.regexp_like(name, F.lit(r"^use\p{IsUppercase}"))


def _parent_path(directory: Column, levels: Column) -> Column:
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    left = F.greatest(F.size(parts) - levels, F.lit(0))
    return F.array_join(F.slice(parts, F.lit(1), left), "/")


def relative_path(raw: Column, directory: Column) -> Column:
    """``./x`` and ``../x`` against the importing file's folder, by arithmetic;
    any other dotted path is left as it is.  The top folder has no prefix."""
    levels = F.regexp_count(raw, F.lit(r"\.\./"))
    base = _parent_path(directory, levels)
    rest = F.regexp_replace(F.replace(raw, F.lit("../"), F.lit("")), "^/+", "")
    up = F.when(base == "", rest).otherwise(
        F.btrim(F.concat(base, F.lit("/"), rest), F.lit("/"))
    )
    tail = F.substr(raw, F.lit(3))
    here = F.rtrim(
        F.when(directory == "", tail).otherwise(
            F.concat(directory, F.lit("/"), tail)
        ),
        F.lit("."),
    )
    return (
        F.when(F.startswith(raw, F.lit("./")), here)
        .when(F.startswith(raw, F.lit("../")), up)
        .otherwise(raw)
    )


def _rule_class_type(context: Column) -> Column:
    name = context["name"]
    window = F.concat(
        context["before"], first_chars(context["after"], fixed.JS_RULE_CLASS_WINDOW[1])
    )
    decorated = bind(
        F.get(mentioned(window, fixed.JS_RULE_DECORATORS), F.lit(0)),
        lambda d: F.when(d == "Controller", "nestjs_controller").when(
            d.isNotNull(), "nestjs_service"
        ),
    )
    component = F.regexp_like(name, F.lit(r"^\p{IsUppercase}")) & _like(
        context["after"], fixed.JS_RULE_RETURNS_MARKUP
    )
    return F.coalesce(
        decorated, F.when(component, "react_component").otherwise("class")
    )


def _rule_function_type(name: Column, markup_file: Column) -> Column:
    component = markup_file & F.regexp_like(name, F.lit(r"^\p{IsUppercase}"))
    return (
        F.when(_is_hook(name), "react_hook")
        .when(component, "react_component")
        .when(name.isin(*fixed.NEXT_DATA_FUNCTIONS), "nextjs_data_fn")
        .otherwise("function")
    )


def js_rule_facts(text: Column, ext: Column, directory: Column) -> Column:
    markup_file = ext.isin(".jsx", ".tsx")
    arrays = [
        F.transform(
            find_all(text, pattern),
            lambda n, i: fact(stage, i, n, F.lit(t)),
        )
        for stage, (pattern, t) in enumerate(
            [
                (fixed.JS_RULE_INTERFACE, "interface"),
                (fixed.JS_RULE_TYPE, "type_alias"),
                (fixed.JS_RULE_ENUM, "enum"),
            ]
        )
    ]
    back, on = fixed.JS_RULE_CLASS_WINDOW
    arrays.append(
        F.transform(
            match_contexts(
                text, fixed.JS_RULE_CLASS, back, max(on, fixed.JS_RULE_MARKUP_WINDOW)
            ),
            lambda c, i: fact(3, i, c["name"], _rule_class_type(c)),
        )
    )
    # the noise test meets lower-cased names, so only lower-case entries count
    functions = F.filter(
        F.array_distinct(
            F.concat(
                find_all(text, fixed.JS_RULE_FUNCTION),
                find_all(text, fixed.JS_RULE_VARIABLE),
            )
        ),
        lambda n: ~F.lower(n).isin(*fixed.JS_RULE_NOISE),
    )
    arrays.append(
        F.transform(
            functions,
            lambda n, i: fact(4, i, n, _rule_function_type(n, markup_file)),
        )
    )
    imported = F.filter(
        F.transform(
            F.concat(*[find_all(text, p) for p in fixed.JS_RULE_IMPORTS]),
            lambda p: F.regexp_replace(p, java_regex(r"\A\s+|\s+\z"), ""),
        ),
        lambda p: (p != "") & ~F.lower(p).isin(*fixed.JS_RULE_NOISE),
    )

    def routed(raw: Column, i: Column) -> Column:
        dotted = F.startswith(raw, F.lit("."))
        return fact(
            5,
            i,
            F.when(dotted, relative_path(raw, directory)).otherwise(
                F.substring_index(raw, "/", 1)
            ),
            F.when(dotted, "path").otherwise("npm_package"),
            is_ref=True,
        )

    arrays.append(F.transform(imported, routed))
    return F.concat(*arrays)
