"""Rule tables of the languages that patterns alone can read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from .facts import Rule, rule_facts


def _first_segment(separator: str):
    return lambda found: F.transform(
        found, lambda t: F.substring_index(t, separator, 1)
    )


def _go_packages(found: Column) -> Column:
    absolute = F.filter(found, lambda t: ~F.startswith(t, F.lit(".")))
    last = F.transform(absolute, lambda t: F.substring_index(t, "/", -1))
    return F.filter(last, lambda t: t != "")


def _dart_packages(found: Column) -> Column:
    known = F.filter(
        found,
        lambda t: F.startswith(t, F.lit("package:")) | F.startswith(t, F.lit("dart:")),
    )
    named = F.transform(
        known,
        lambda t: F.when(
            F.startswith(t, F.lit("package:")),
            F.substring_index(F.element_at(F.split(t, ":"), 2), "/", 1),
        ).otherwise(t),
    )
    return F.filter(named, lambda t: t != "")


def _rust_roots(found: Column) -> Column:
    roots = F.transform(
        found, lambda t: F.element_at(F.split(_strip(t), "::"), 1)
    )
    return F.filter(
        roots, lambda t: (t != "") & ~t.isin(*fixed.RUST_LOCAL_ROOTS)
    )


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


CPP = [
    Rule(fixed.CPP_CLASS, "class"),
    Rule(fixed.CPP_FUNCTION, "function", exclude=fixed.CPP_NOT_FUNCTIONS),
    Rule(fixed.CPP_INCLUDE, "header", is_ref=True),
    Rule(fixed.CPP_NAMESPACE, "namespace"),
]
CSHARP = [
    Rule(fixed.CSHARP_CLASS, "class"),
    Rule(fixed.CSHARP_METHOD, "method", exclude=fixed.CSHARP_NOT_METHODS),
    Rule(fixed.CSHARP_USING, "namespace", is_ref=True, target=_first_segment(".")),
    Rule(fixed.CSHARP_NAMESPACE, "namespace"),
]
DART = [
    Rule(fixed.DART_WIDGET, "widget"),
    Rule(fixed.DART_CLASS, "class", unless_seen=True),
    Rule(
        fixed.DART_FUNCTION, "function", exclude=fixed.DART_NOT_FUNCTIONS,
        unless_seen=True,
    ),
    Rule(fixed.DART_IMPORT, "module", is_ref=True, target=_dart_packages),
]
GO = [
    Rule(fixed.GO_FUNCTION, "function"),
    Rule(fixed.GO_STRUCT, "struct"),
    Rule(fixed.GO_INTERFACE, "interface"),
    Rule(fixed.GO_QUOTED, "module", is_ref=True, target=_go_packages),
]
JAVA = [
    Rule(fixed.JAVA_CLASS, "class"),
    Rule(fixed.JAVA_METHOD, "method", exclude=fixed.JAVA_NOT_METHODS),
    Rule(fixed.JAVA_IMPORT, "module", is_ref=True, target=_first_segment(".")),
]
PROTO = [
    Rule(fixed.PROTO_SERVICE, "service"),
    Rule(fixed.PROTO_MESSAGE, "message"),
    Rule(fixed.PROTO_RPC, "rpc"),
    Rule(fixed.PROTO_IMPORT, "proto", is_ref=True),
]
RUBY = [
    Rule(fixed.RUBY_CLASS, "class"),
    Rule(fixed.RUBY_MODULE, "module"),
    Rule(fixed.RUBY_METHOD, "method"),
    Rule(fixed.RUBY_REQUIRE, "module", is_ref=True),
    Rule(fixed.RUBY_INCLUDE, "includes", is_ref=True),
]
RUST = [
    Rule(fixed.RUST_FUNCTION, "function"),
    Rule(fixed.RUST_STRUCT, "struct"),
    Rule(fixed.RUST_ENUM, "enum"),
    Rule(fixed.RUST_TRAIT, "trait"),
    Rule(fixed.RUST_IMPL, "implements", is_ref=True),
    Rule(fixed.RUST_USE, "module", is_ref=True, target=_rust_roots),
]
SWIFT = [
    Rule(fixed.SWIFT_CLASS, "class"),
    Rule(fixed.SWIFT_FUNCTION, "function"),
    Rule(fixed.SWIFT_IMPORT, "module", is_ref=True),
]

LANGUAGES: dict[str, tuple[tuple[str, ...], list[Rule]]] = {
    "cpp": (fixed.CPP_EXTENSIONS, CPP),
    "csharp": (fixed.CSHARP_EXTENSIONS, CSHARP),
    "dart": (fixed.DART_EXTENSIONS, DART),
    "go": (fixed.GO_EXTENSIONS, GO),
    "java": (fixed.JAVA_EXTENSIONS, JAVA),
    "proto": (fixed.PROTO_EXTENSIONS, PROTO),
    "ruby": (fixed.RUBY_EXTENSIONS, RUBY),
    "rust": (fixed.RUST_EXTENSIONS, RUST),
    "swift": (fixed.SWIFT_EXTENSIONS, SWIFT),
}


def language_facts(language: str, text: Column) -> Column:
    return rule_facts(LANGUAGES[language][1], text)
