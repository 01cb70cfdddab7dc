"""Text expressions: decoding, regular-expression dialect, match contexts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What \w and \s mean for Unicode text, in java.util.regex notation.
WORD = r"[\p{L}\p{N}_]"
SPACE = (
    r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)


def java_regex(pattern: str) -> str:
    r"""Unicode ``\w``/``\s``, ``^`` after ``\n`` only, ``.`` stops at ``\n`` only."""
    return "(?md)" + pattern.replace(r"\w", WORD).replace(r"\s", SPACE)


def decode_text(content: Column) -> Column:
    """UTF-8, else Latin-1, with every line end turned into a line feed."""
    as_utf8 = content.cast("string")
    text = F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(
        F.decode(content, "ISO-8859-1")
    )
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")


def find_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(java_regex(pattern)), F.lit(group))


def last_chars(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def join_before(parts: Column, upto: Column, n: int) -> Column:
    """The last ``n`` characters of ``parts[0 .. upto)`` joined.

    Every part holds at least one character, so ``n`` parts always suffice and
    the joined piece stays bounded however long the file is.
    """
    start = F.greatest(upto - n, F.lit(0))
    return last_chars(F.array_join(F.slice(parts, start + 1, upto - start), ""), n)


def join_after(parts: Column, start: Column, n: int) -> Column:
    """The first ``n`` characters of ``parts[start ..]`` joined."""
    return first_chars(F.array_join(F.slice(parts, start + 1, F.lit(n)), ""), n)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also inside array lambdas,
    where an outer expression would be computed anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def match_contexts(text: Column, pattern: str, before: int, after: int) -> Column:
    """Array of (name, before, after) for each match of ``pattern``.

    ``before`` ends where the match starts, ``after`` begins there, so the two
    are the text window around the match offset.
    """
    regex = java_regex(pattern)
    names = F.regexp_extract_all(text, F.lit(regex), F.lit(1))
    matches = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    # text = gaps[0] + matches[0] + gaps[1] + matches[1] + ...
    gaps = F.split(text, regex, -1)
    segments = F.zip_with(
        matches, F.slice(gaps, F.lit(2), F.size(matches)), lambda m, gap: F.concat(m, gap)
    )
    parts = F.struct(
        names.alias("names"), segments.alias("segments"), F.get(gaps, F.lit(0)).alias("lead")
    )

    def contexts(p: Column) -> Column:
        return F.transform(
            p["names"],
            lambda name, i: F.struct(
                name.alias("name"),
                last_chars(
                    F.concat(
                        last_chars(p["lead"], before),
                        join_before(p["segments"], i, before),
                    ),
                    before,
                ).alias("before"),
                join_after(p["segments"], i, after).alias("after"),
            ),
        )

    return bind(parts, contexts)


def mentioned(text: Column, names) -> Column:
    """Those of ``names`` that occur as ``@Name`` in the text, in listed order.
    No name of a list may be the start of another."""
    found = F.regexp_extract_all(text, F.lit("@(" + "|".join(names) + ")"), F.lit(1))
    return F.array_intersect(F.array(*[F.lit(n) for n in names]), found)
