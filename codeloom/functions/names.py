"""Scalar expressions over ids and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed
from .text import WORD


def normalise_id(node_id: Column) -> Column:
    return F.replace(node_id, F.lit("\\"), F.lit("/"))


def file_extension(name: Column) -> Column:
    """Lower-cased last suffix; empty for ``.bashrc``, ``name.`` and ``name``."""
    return F.lower(F.regexp_extract(name, r"(?s)[^.].*?(\.[^.]+)$", 1))


def classify_file(name: Column) -> Column:
    lowered = F.lower(name)
    out = None
    for words, node_type in fixed.FILE_CLASSES:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(lowered, F.lit(word))
        out = F.when(hit, node_type) if out is None else out.when(hit, node_type)
    return out.otherwise(fixed.DEFAULT_FILE_CLASS)


def keywords(node_id: Column, node_type: Column) -> Column:
    words = F.regexp_extract_all(F.lower(node_id), F.lit(WORD + "+"), F.lit(0))
    return F.filter(
        F.array_union(words, F.array(F.lower(node_type))), lambda w: F.length(w) > 2
    )


def phrase_words(phrase: Column) -> Column:
    words = F.regexp_extract_all(F.lower(phrase), F.lit(WORD + "+"), F.lit(0))
    return F.filter(F.array_distinct(words), lambda w: F.length(w) > 2)


def symbol_of(node_id: Column) -> Column:
    """What follows the first ``::``, null where there is none."""
    at = F.instr(node_id, "::")
    return F.when(at > 0, F.substr(node_id, at + 2))


def page_name(node_id: Column) -> Column:
    name = normalise_id(node_id)
    clean = F.regexp_replace(name, r'[\\/:*?"<>|()\n\r\t]', "_")
    clean = F.btrim(F.regexp_replace(clean, "_+", "_"), F.lit("_"))
    clipped = F.concat(
        F.substring(clean, 1, fixed.PAGE_NAME_KEEP),
        F.lit("__"),
        F.substring(F.sha1(name), 1, fixed.PAGE_NAME_DIGEST),
    )
    return (
        F.when(F.length(clean) > fixed.PAGE_NAME_LIMIT, clipped)
        .when(clean == "", fixed.EMPTY_PAGE_NAME)
        .otherwise(clean)
    )


def wiki_link(node_id: Column) -> Column:
    return F.concat(F.lit("[["), page_name(node_id), F.lit("]]"))


def capitalise(text: Column) -> Column:
    return F.concat(
        F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2)))
    )


def decoded_path(uri: Column) -> Column:
    """A file's path as it is spelt, from the URI that Spark reports."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
