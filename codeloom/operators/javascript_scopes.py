"""The scopes of a JavaScript or TypeScript file: what stands between each pair of brackets.

A small helper for one text.  It sets comments, strings, template text and regular
expressions apart, pairs brackets, and gives each scope as one line of its own tokens, in
which an inner scope is only its number in its brackets.  Nothing is interpreted here;
declarations are found by patterns over these lines (``javascript_source``).

A scope's line starts with ``;`` where statements may stand, else with ``,``; a line
break in the source is one before the token, any other gap a space.  A name carries
its offset (``class#120``), a string keeps its text in quotes without spaces, templates and
regular expressions are a back quote each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..functions import fixed_values as fixed

SCOPES = "array<struct<start:bigint,end:bigint,text:string>>"
MARKERS = "array<struct<name:string,start:bigint,end:bigint>>"

_TOKEN = re.compile(
    r"""(?P<space>[^\S\n\r  ]+)|(?P<line>[\n\r  ]+)|(?P<note>//[^\n\r]*|/\*.*?(?:\*/|\Z))
    |(?P<name>[\w$]+)|(?P<quote>["'])
    |(?P<sign>=>|\?\.|\.\.\.|===?|!==?|<=|>=|&&|\|\||\?\?|[^\s])""",
    re.VERBOSE | re.DOTALL,
)
_STRINGS = {q: re.compile(rf"{q}(?:[^{q}\\\n\r]|\\.)*{q}", re.DOTALL) for q in "\"'"}
_REGEX = re.compile(r"/(?![*/>])(?:[^/\\\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{|\Z)", re.DOTALL)
_LINE_END = re.compile(r"[\n\r]|\Z")
_CLOSES = {"(": ")", "[": "]", "{": "}", "${": "}", "<": ">"}
_SHOWN = {"(": "({})", "[": "[{}]", "{": "{{{}}}", "${": "${}$", "<": "<{}>"}
# a slash after these divides, or closes markup
_OPERAND_ENDS = (")", "]", "}", "<")
_VALUE_WORDS = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "await", "yield"}
# no angle brackets pair across a statement that starts a line
_STATEMENT_WORDS = {
    "const", "let", "var", "function", "class", "export", "import", "if", "for", "while", "do",
    "switch", "return", "throw", "try", "interface", "type", "enum", "namespace", "declare", "async",
    "abstract",
}
_MARKER = re.compile(
    "@(?:" + "|".join(fixed.NEST_CLASS_DECORATORS + fixed.NEST_ROUTE_DECORATORS) + ")|" + fixed.RETURNS_MARKUP
)


def _tokens(text: str) -> Iterator[tuple[str, str, int, bool]]:
    """(kind, text, offset, whether a line break stands before it)."""
    at, end, new_line, last = 0, len(text), True, ("sign", "")
    braces: list[bool] = []  # open braces; true for those of a template
    # up to where a quote or a regular expression is known not to close on its line
    unclosed = {'"': 0, "'": 0, "/": 0}

    def matched(pattern: re.Pattern, char: str) -> re.Match | None:
        if at < unclosed[char]:
            return None
        if not (m := pattern.match(text, at)):
            unclosed[char] = _LINE_END.search(text, at).end()
        return m

    while at < end:
        char = text[at]
        opens_regex = last[1] in _VALUE_WORDS if last[0] == "name" else (
            last[0] == "sign" and last[1] not in _OPERAND_ENDS
        )
        if char == "/" and opens_regex and text[at + 1 : at + 2] not in ("/", "*", ">") and (m := matched(_REGEX, char)):
            last, at = ("value", "`", at, new_line), m.end()
        elif char == "`" or char == "}" and braces and braces[-1]:
            if char == "}":
                braces.pop()
                yield "sign", "}", at, False
            else:
                yield "value", "`", at, new_line
            m, last = _TEMPLATE.match(text, at + 1), ("value", "`")
            at, new_line = m.end(), False
            if m[1] == "${":
                braces.append(True)
                last = ("sign", "${")
                yield "sign", "${", at - 2, False
            continue
        else:
            m = _TOKEN.match(text, at)
            kind, start = m.lastgroup, at
            if kind == "quote" and (string := matched(_STRINGS[char], char)):
                m, kind = string, "string"
            at = m.end()
            if kind in ("space", "line", "note"):
                new_line = new_line or kind == "line" or kind == "note" and "\n" in m[0]
                continue
            last = ("sign" if kind == "quote" else kind, m[0], start, new_line)
            if m[0] == "{":
                braces.append(False)
            elif m[0] == "}" and braces:
                braces.pop()
        new_line = False
        yield last


def _pairs(tokens: list[tuple[str, str, int, bool]]) -> dict[int, int]:
    """Place of each opening bracket to that of its end; an unpaired one ends with the text.
    Angle brackets count where they pair within a statement."""
    pairs: dict[int, int] = {}
    opened: list[int] = []

    def drop_angles() -> None:
        while opened and tokens[opened[-1]][1] == "<":
            opened.pop()

    for i, (kind, text, _, new_line) in enumerate(tokens):
        if kind == "name" and new_line and text in _STATEMENT_WORDS:
            drop_angles()
        if kind != "sign":
            continue
        if text in _CLOSES:
            opened.append(i)
        elif text == ">":
            if opened and tokens[opened[-1]][1] == "<":
                pairs[opened.pop()] = i
        elif text in (")", "]", "}", ";"):
            drop_angles()
            # an unpaired bracket closes nothing
            if opened and _CLOSES[tokens[opened[-1]][1]] == text:
                pairs[opened.pop()] = i
    for i in opened:
        if tokens[i][1] != "<":
            pairs[i] = len(tokens)
    return pairs


def scopes(text: str) -> list[tuple[int, int, str]]:
    """(start, end, line) of each scope, the file first; a scope's number is its place."""
    tokens = list(_tokens(text))
    pairs = _pairs(tokens)
    found, lines = [[0, len(text)]], [[";"]]
    inside, ends = [0], [len(tokens)]
    for i, (kind, token, at, new_line) in enumerate(tokens):
        if ends[-1] == i:
            while ends[-1] == i:
                ends.pop()
                found[inside.pop()][1] = at
            continue
        shown = f"{token}#{at}" if kind == "name" else token
        if kind == "string":
            shown = '"' + token[1:-1].replace(" ", "\x01").replace("\n", "\x01") + '"'
        elif i in pairs:
            shown = _SHOWN[token].format(len(found))
        lines[inside[-1]].append(("\n" if new_line else " ") + shown)
        if i in pairs:
            inside.append(len(found))
            ends.append(pairs[i])
            found.append([at, len(text)])
            lines.append([";" if token == "{" else ","])
    return [(start, end, "".join(line)) for (start, end), line in zip(found, lines)]


def markers(text: str) -> list[tuple[str, int, int]]:
    """(name, start, end) of every ``@Name`` that classifies and every return of markup."""
    return [(m[0] if m[0][0] == "@" else "<", m.start(), m.end()) for m in _MARKER.finditer(text)]
