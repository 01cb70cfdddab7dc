"""Declarations and static imports of JavaScript and TypeScript files.

A file's scopes (``javascript_scopes``) are lines of tokens, so a declaration is a pattern
over one line whatever it spans in the source: on one line or many, indented or not, in
blocks, namespaces, calls and function expressions.  A match takes everything up to the
statement's end, and what lies in the scopes that it takes is closed: bodies of declared
functions and classes and values bound by ``const`` and ``let`` keep their declarations to
themselves.  A match counts unless an earlier one of the file reaches over it, which a
running maximum over the matches' ends tells.  The text windows that classify a
declaration are range frames over the markers around it.

One scan yields matches and markers; the text goes no further, and only these few rows are
dealt by file.  Every repetition is possessive, so patterns neither recurse nor
backtrack.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from .facts import FACTS_SCHEMA
from .javascript_scopes import MARKERS, SCOPES, markers, scopes

TYPED = (".ts", ".tsx")

# ---------------------------------------------------------------- patterns of tokens

_GAP = r"[ \n]"
_END = r"(?=[ \n]|$)"
_ANY = r"[^ \n]++"
_WORD = r'[^ \n#"]++#\d++'
_NAME = r'([^ \n#"0-9][^ \n#"]*+)#\d++'
_GROUP = r"(?:\(\d++\)|\[\d++\]|<\d++>|\$\d++\$)"
_GENERICS = rf"(?:{_GAP}<\d++>)?+"
_PARAMS = rf"{_GAP}\(\d++\)"
_BODY = rf"{_GAP}\{{(\d++)\}}"


def _words(*words: str) -> str:
    return rf"(?:{'|'.join(words)})#\d++"


# a type: operands joined by operators, on as many lines as operators carry it
_TYPE_WORD = _words(
    "is", "extends", "keyof", "in", "asserts", "infer", "typeof", "readonly", "unique", "new", "abstract"
)
_OPERAND = rf'{_GAP}(?:{_GROUP}|\{{\d++\}}|"[^ \n]*+|`|{_WORD})'
_LEADS = rf"(?:{_GAP}(?:[|&]{_END}|-{_END}|{_TYPE_WORD}))*+"


def _type(operators: str) -> str:
    step = rf"{_GAP}(?:(?:{operators}){_END}|{_TYPE_WORD}){_LEADS}{_OPERAND}"
    return rf"{_GAP}:{_LEADS}{_OPERAND}(?:{step}|{_GAP}{_GROUP}| {_WORD})*+"


_TYPE = _type(r"[|&.?:\-]|=>")
_RETURN_TYPE = _type(r"[|&.?:\-]")  # of an arrow function, up to its arrow

# what goes on with an expression on the next line: an open operator before, or one after
_GOES_ON = (
    r'\n(?:(?<=(?:[^0-9"`})\]>$ \n]|=>)\n)'
    rf"|(?=(?:\?\.|===?|!==?|<=|>=|=>|&&|\|\||\?\?|[.+\-*/%=<>&|^?:,()\[\]}}])(?:{_END}|\d)))"
)

# where a statement may start: at the start of a scope, after a block, brackets or
# semicolon, on a new line after something complete, or after ``else``
_VALUE_WORDS = r"return|typeof|case|in|of|do|else|void|delete|throw|new|await|yield"
_START = (
    r"(?:(?<=[;})][ \n])|(?<=[\"`\]$]\n)|(?<=[\d ]>\n)|(?<=[ \n]:\n)"
    rf"|(?<=\d\n)(?<![ \n](?:{_VALUE_WORDS})#\d{{1,9}}\n)"
    r"|(?<=[ \n]else#\d{1,9}[ \n]))"
)
_DECORATOR = rf"@{_GAP}{_NAME}(?:{_GAP}\.{_GAP}{_WORD})*+(?: \(\d++\))?+"
_LEAD = rf"(?:(?:{_DECORATOR}|{_words('export', 'default', 'abstract', 'declare', 'async')}){_GAP})*+"

# a class takes all tokens up to its body, a function without body only its parameters
_CLASS = (
    rf"(?<!abstract#\d{{1,9}}[ \n])class#(\d++){_GAP}(?!extends#){_NAME}"
    rf"(?:{_GAP}(?!\{{\d){_ANY})*+(?:{_BODY})?+"
)
_FUNCTION = rf"function#(\d++){_GAP}{_NAME}{_GENERICS}{_PARAMS}(?:(?:{_TYPE})?+{_BODY})?+"
_STOP = rf"(?![,;}})]{_END})"
_VALUE = rf"(?: {_STOP}{_ANY}|{_GOES_ON}{_STOP}{_ANY})*+"
_DECLARATOR = rf"{_GAP}{_ANY}(?:{_GAP}!{_END})?+(?:{_TYPE})?+(?:{_GAP}={_GAP}{_STOP}{_ANY})?+{_VALUE}"
_BINDING = rf"{_words('const', 'let')}(?!{_GAP}enum#){_DECLARATOR}(?:{_GAP},{_DECLARATOR})*+"
_IMPORT = rf'import#\d++(?!{_GAP}[(.])(?:{_GAP}(?!"|[;=]{_END}){_ANY})*+(?:{_GAP}"[^ \n]*+)?+'
_INTERFACE = (
    rf"interface#\d++{_GAP}{_NAME}(?={_GAP}(?:\{{\d|<\d|extends#))(?:{_GAP}(?!\{{\d){_ANY})*+(?:{_BODY})?+"
)
_ALIAS = rf"type#\d++{_GAP}{_NAME}{_GENERICS}{_GAP}={_END}"

_UNTYPED_STATEMENT = rf"{_START}{_LEAD}(?:{_CLASS}|{_FUNCTION}|{_BINDING}|{_IMPORT})"
_TYPED_STATEMENT = rf"{_START}{_LEAD}(?:{_CLASS}|{_FUNCTION}|{_BINDING}|{_IMPORT}|{_INTERFACE}|{_ALIAS})"
_KIND = r"(?<![@.][ \n])(?<![^ \n])(class|function|const|let|import|interface|type)#"
_LAST_SCOPE = r"(?s)\A.*[ \n][({\[<$](\d++)[)}\]>$](?=[ \n]|$)"
# of a binding's declarators those whose value is an arrow function
_ARROW = (
    rf"(?<=(?:const|let)#\d{{1,9}}[ \n]|[ \n],[ \n]){_NAME}(?:{_GAP}!{_END})?+(?:{_TYPE})?+{_GAP}={_GAP}"
    rf"(?:async#\d++{_GAP}(?!=>))?+(?:<\d++>{_GAP})?+(?:{_WORD}{_GAP}=>|\(\d++\)(?:{_RETURN_TYPE})?+{_GAP}=>){_END}"
)

# members one after another: a method, else a field or signature up to its end
_MODIFIERS = (
    rf"(?:{_words('public', 'private', 'protected', 'static', 'async', 'get', 'set', 'override', 'readonly', 'abstract', 'declare', 'accessor')}"
    rf"(?!{_GAP}(?:\(|={_END}|;|:|\?{_END}|!{_END}|<|\}}|,{_END})){_GAP})*+"
)
_METHOD = (
    rf'(?=(?:\*{_GAP})?+[^ \n#"]*+#?(\d*+)){_MODIFIERS}(?:\*{_GAP})?+(?:{_NAME}{_END}|#{_GAP}{_ANY}|(?!@){_ANY})'
    rf"(?:{_GAP}[?!]{_END})?+{_GENERICS}{_PARAMS}(?:{_TYPE})?+{_BODY}"
)
_FIELD = rf"{_MODIFIERS}(?:\*{_GAP})?+(?:#{_GAP})?+{_ANY}(?: (?!;{_END}){_ANY}|{_GOES_ON}(?!;{_END}){_ANY})*+"
_MEMBER = (
    rf"\G(?:^;|{_GAP}(?:[;,}}]{_END}|@{_GAP}{_WORD}(?:{_GAP}\.{_GAP}{_WORD})*+(?: \(\d++\))?+|{_METHOD}|{_FIELD}))"
)

EVENT = (
    "struct<what:string,name:string,owner:string,own:string,scope_at:bigint,at:bigint,end:bigint>"
)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def _event(what, name, scope_at, at, end, owner=None, own=None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        (F.lit(what) if isinstance(what, str) else what).alias("what"),
        (null if name is None else name).alias("name"),
        (null if owner is None else owner).alias("owner"),
        (null if own is None else own).alias("own"),
        scope_at.alias("scope_at"), at.cast("bigint").alias("at"), end.alias("end"),
    )


def _none() -> Column:
    return F.array().cast(f"array<{EVENT}>")


def _class_events(match: Column, at: Column, end: Column, lines: Column) -> Column:
    """A class and its methods.  Only an exported class owns its decorators; any other one
    stands where its first decorator stands."""
    name = _group(match, _CLASS, 2)
    lead = F.substring_index(match, "class#", 1)
    exported = F.regexp_like(lead, F.lit(r"(?<![^ \n])export#"))
    own = F.get(
        F.filter(
            _all(lead, rf"@{_GAP}(?:{_WORD}{_GAP}\.{_GAP})*+{_NAME}", 1),
            lambda d: d.isin(*fixed.NEST_CLASS_DECORATORS),
        ),
        F.lit(0),
    )
    decorated = F.startswith(match, F.lit("@")) & ~exported
    stands = F.when(decorated, at - 1).otherwise(_group(match, _CLASS, 1).cast("bigint"))
    body = F.get(lines, _group(match, _CLASS, 3).try_cast("int"))["text"]
    members = F.arrays_zip(
        _all(body, _MEMBER, 1).alias("at"), _all(body, _MEMBER, 2).alias("name"),
        _all(body, _MEMBER, 3).alias("body"),
    )
    methods = F.filter(
        members, lambda m: (m["name"] != "") & (m["body"] != "") & ~m["name"].isin(*fixed.JS_NOISE)
    )
    return F.concat(
        F.array(_event("class", name, at, stands, end, own=F.when(exported, own))),
        F.coalesce(
            F.transform(
                methods,
                lambda m: _event("method", m["name"], at, m["at"], F.lit(None).cast("bigint"), owner=name),
            ),
            _none(),
        ),
    )


def _events_of(match: Column, lines: Column) -> Column:
    """Events of one matched statement; one that declares nothing but holds scopes is a
    ``span``, which only closes them."""
    kind = _group(match, _KIND)
    at = _group(match, r"#(\d++)").cast("bigint")
    end = F.get(lines, _group(match, _LAST_SCOPE).try_cast("int"))["end"]
    name = _group(match, _FUNCTION, 2)
    declared = (_group(match, _FUNCTION, 3) != "") & ~name.isin(*fixed.JS_NOISE)
    function_at = F.coalesce(
        _group(match, r"async#(\d++)[ \n]function#").try_cast("bigint"), _group(match, _FUNCTION, 1).try_cast("bigint")
    )
    arrows = F.transform(
        F.filter(_all(match, _ARROW), lambda a: ~_group(a, _NAME).isin(*fixed.JS_NOISE)),
        lambda a: _event("function", _group(a, _NAME), at, _group(a, r"#(\d++)"), end),
    )
    path = _group(match, r'(?s)[ \n]"([^ \n]*)"$')
    typed = F.array(
        _event(
            F.when(kind == "type", "type_alias").otherwise(kind),
            _group(match, rf"(?:interface|type)#\d++{_GAP}{_NAME}"), at, at, end,
        )
    )
    found = (
        F.when(kind == "class", _class_events(match, at, end, lines))
        .when((kind == "function") & declared, F.array(_event("function", name, at, function_at, end)))
        .when(kind.isin("const", "let"), arrows)
        .when(
            (kind == "import") & F.regexp_like(match, F.lit(r'[ \n]"[^ \n]*"$')),
            F.array(_event("import", F.translate(path, "\x01", " "), at, at, F.lit(None).cast("bigint"))),
        )
        .when(kind.isin("interface", "type"), typed)
        .otherwise(_none())
    )
    return F.when(
        (F.size(found) == 0) & end.isNotNull() & (kind != "import"),
        F.array(_event("span", None, at, at, end)),
    ).otherwise(found)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [t or "" for t in batch["content"]]
        yield pd.DataFrame(
            {
                "repo": batch["repo"], "file_id": batch["file_id"], "ext": batch["ext"],
                "scopes": [[dict(zip(("start", "end", "text"), s)) for s in scopes(t)] for t in texts],
                "markers": [[dict(zip(("name", "start", "end"), m)) for m in markers(t)] for t in texts],
            }
        )


def script_events(files: DataFrame) -> DataFrame:
    """(repo, file_id, what, name, owner, own, scope_at, at, end): matched declarations,
    closed spans and markers of every file."""
    read = files.select("repo", "file_id", "ext", "content").mapInPandas(
        _read, f"repo string, file_id string, ext string, scopes {SCOPES}, markers {MARKERS}"
    )
    lines = F.col("scopes")
    matches = F.flatten(
        F.transform(
            lines,
            lambda s: F.when(F.col("ext").isin(*TYPED), _all(s["text"], _TYPED_STATEMENT))
            .otherwise(_all(s["text"], _UNTYPED_STATEMENT)),
        )
    )
    declared = F.flatten(F.transform(matches, lambda m: _events_of(m, lines)))
    marked = F.transform(
        "markers",
        lambda m: _event("marker", m["name"], m["start"], m["start"], m["end"]),
    )
    return read.select(
        "repo", "file_id", F.explode(F.concat(declared, marked)).alias("e")
    ).select("repo", "file_id", "e.*")


def _classified(events: DataFrame) -> Column:
    """The type of a declaration, by its own decorators, its name and the markers around it."""
    back, on = fixed.CLASS_WINDOW

    def within(names, before: int, after: int) -> Column:
        return F.filter(
            "around",
            lambda m: m["name"].isin(*names) & (m["at"] >= F.col("at") - before) & (m["end"] <= F.col("at") + after),
        )

    def seen(names, before: int, after: int) -> Column:
        return F.size(within(names, before, after)) > 0

    named = tuple("@" + d for d in fixed.NEST_CLASS_DECORATORS)
    order = F.array(*[F.lit(n) for n in named])
    first = F.get(
        F.array_intersect(order, F.transform(within(named, back, on), lambda m: m["name"])), F.lit(0)
    )
    decorator = F.coalesce("own", F.substring(first, 2, 100))
    upper = F.regexp_like("name", F.lit(r"^[A-Z]"))
    return (
        F.when(
            F.col("what") == "class",
            F.when(decorator.isNotNull(), F.concat(F.lit("nestjs_"), F.lower(decorator)))
            .when(upper & seen("<", back, on), "react_component").otherwise("class"),
        )
        .when(
            F.col("what") == "method",
            F.when(
                seen(tuple("@" + d for d in fixed.NEST_ROUTE_DECORATORS), *fixed.METHOD_WINDOW), "nestjs_endpoint"
            ).otherwise("method"),
        )
        .when(
            F.col("what") == "function",
            F.when(F.regexp_like("name", F.lit(r"^use\p{IsUppercase}")), "react_hook")
            .when(F.col("name").isin(*fixed.NEXT_DATA_FUNCTIONS), "nextjs_data_fn")
            .when(upper & seen("<", 0, fixed.FUNCTION_WINDOW), "react_component").otherwise("function"),
        )
        .when(F.col("what") == "import", "js")
        .otherwise(F.col("what"))
    )


def script_facts(files: DataFrame) -> DataFrame:
    """Facts of JavaScript and TypeScript files: definitions (stage 0) and static imports
    (stage 1), by offset."""
    by_file = W.partitionBy("repo", "file_id")
    before = by_file.orderBy("scope_at").rangeBetween(W.unboundedPreceding, -1)
    back, on = (max(w) for w in zip(fixed.CLASS_WINDOW, fixed.METHOD_WINDOW, (0, fixed.FUNCTION_WINDOW)))
    near = by_file.orderBy("at").rangeBetween(-back, on)
    marker = F.col("what") == "marker"
    events = script_events(files).withColumn(
        "reached", F.max(F.when(~marker, F.col("end"))).over(before)
    )
    open_ = events.filter(marker | F.col("reached").isNull() | (F.col("reached") <= F.col("scope_at")))
    around = F.collect_list(F.when(marker, F.struct("name", "at", "end"))).over(near)
    counted = open_.filter(F.col("what") != "span").withColumn("around", around).filter(~marker)
    is_ref = F.col("what") == "import"
    columns = [f.split()[0] for f in FACTS_SCHEMA.split(", ")]
    return counted.select(
        "repo", "file_id", F.when(is_ref, 1).otherwise(0).alias("stage"), F.col("at").alias("pos"),
        is_ref.alias("is_ref"), F.col("owner").alias("parent"), "name", _classified(counted).alias("type"),
    ).select(*columns)
