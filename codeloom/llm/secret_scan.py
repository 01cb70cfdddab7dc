"""Secret scan by dictionary-primed zstandard novelty.

Plain patterns give the base spans.  Further candidates are long strings that stand
in a sensitive context: a word such as ``bearer`` or ``SECRET_KEY`` shortly before or
behind, also as a part of a longer name (``AWS_SECRET_ACCESS_KEY``, ``clientSecret``).
A candidate's novelty is the number of bytes it adds to the compressed size of its
surrounding text, per byte of its own, where the compressor is primed with the
identifiers that are common in sensitive contexts of all documents.  Names and
phrases that the surroundings or the dictionary hold add next to nothing; keys add
nearly their entropy.  Candidates of high novelty are reported as ``novel`` spans;
base spans always stay.

Defined results: null and empty texts have no spans; base spans may overlap between
kinds; a novel span that overlaps a base span or another novel span is not reported again; repeated rows
are scanned each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches

# fixed values: the base patterns with their least lengths, sensitive words
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters and more
HEX = re.compile(r"[0-9a-f]{24,}")
# sensitive words begin where no letter stands before them, or at a change of case
SENSITIVE = re.compile(
    r"(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])))"
    r"(?:auth\w*|bearer|credentials?|secret[_ -]?access[_ -]?key"
    r"|(?:private|access|secret|api|account|encryption|master|shared|signing)[_ -]?key"
    r"|client[_ -]?secret|pwd|passphrase|signature|session[_ -]?id|cookie|jwt|ssh-rsa"
    r"|pass(?:word|wd)|secret|token)",
    re.IGNORECASE | re.ASCII,
)
ASSIGNED = re.compile(r"""["']?\x20*[:=]""")  # behind a name that gets a value
PIECE = re.compile("[^=]+")
LEAST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % LEAST)
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9])[A-Za-z_]{4,40}(?![A-Za-z0-9])")
HUMP = re.compile("[a-z][A-Z]")

REACH = 80  # characters that may lie between a sensitive word and a candidate
AROUND = 400  # characters of surrounding text on either side
NOVELTY = 0.62
DICTIONARY_WORDS = 4096
KINDS = ("assign", "access", "hex", "novel")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain patterns, leftmost and non-overlapping per kind."""
    found = [
        (m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST
    ]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Long strings close to a sensitive word, those to be preferred first: what stands
    between signs of assignment, what a sensitive word inside leaves of it, whole runs.
    The name of a sensitive value is none."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    starts, ends = zip(*words)
    pieces, parts, wholes = [], [], []
    for run in CANDIDATE.finditer(text):
        split, named = _pieces(run), False
        for start, end in split:
            inside = words[bisect_right(ends, start) : bisect_left(starts, end)]
            name = bool(inside) and like_a_name(text[start:end].rstrip("="))
            if name and ASSIGNED.match(text, start + len(text[start:end].rstrip("="))):
                named = True
                continue
            before, behind = _near(starts, ends, start, end)
            own = name and inside[0][0] <= start and end <= inside[0][1]
            if before or (behind and not own) or (inside and not name):
                pieces.append((start, end))
            if inside:
                cuts = [start, *(x for word in inside for x in word), end]
                parts += zip(cuts[::2], cuts[1::2])
        if not named and split != [run.span()] and any(_near(starts, ends, *run.span())):
            wholes.append(run.span())
    found = dict.fromkeys(pieces + parts + wholes)
    return [(start, end) for start, end in found if end - start >= LEAST]


def _pieces(run: re.Match) -> list[tuple[int, int]]:
    """Parts of a run between signs of assignment; those at its end are padding."""
    found = [m.span() for m in PIECE.finditer(run.string, run.start(), run.end())]
    if found:
        found[-1] = (found[-1][0], run.end())
    return found


def _near(starts: tuple, ends: tuple, start: int, end: int) -> tuple[bool, bool]:
    """Whether a sensitive word ends shortly before, and starts shortly behind."""
    before, behind = bisect_right(ends, start) - 1, bisect_left(starts, end)
    return (
        before >= 0 and start - ends[before] <= REACH,
        behind < len(starts) and starts[behind] - end <= REACH,
    )


@lru_cache(maxsize=2)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=9)
    primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed)


def like_a_name(text: str) -> bool:
    """Letters only, and not a new capital every few letters."""
    return bool(IDENTIFIER.fullmatch(text)) and 5 * len(HUMP.findall(text)) <= len(text)


def novelty(text: str, start: int, end: int, dictionary: bytes) -> float:
    """Compressed bytes that the candidate adds to its surroundings, per byte of its own.
    A further copy nearby makes it a known name only if it is spelt like one."""
    around = f"{text[max(0, start - AROUND):start]}\n{text[end:end + AROUND]}\n"
    if not like_a_name(text[start:end]):
        around = around.replace(text[start:end], "")
    around, own = around.encode(), text[start:end].encode()
    pack = _compressor(dictionary).compress
    return (len(pack(around + own)) - len(pack(around))) / len(own)


def all_spans(text: str, dictionary: bytes) -> list[tuple[int, int, int]]:
    spans = base_spans(text)
    taken = bytearray(len(text))
    for start, _, end in spans:
        taken[start:end] = b"\1" * (end - start)
    for start, end in candidates(text):
        if taken.find(1, start, end) < 0 and novelty(text, start, end, dictionary) >= NOVELTY:
            taken[start:end] = b"\1" * (end - start)
            spans.append((start, 3, end))
    return sorted(spans)


def identifiers(docs: DataFrame, text_col: str) -> bytes:
    """Dictionary of the identifiers that are most frequent near sensitive words, over
    all documents; the most frequent last, where zstandard reaches them most cheaply."""

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        counts: Counter = Counter()
        for text in batch.column(0).to_pylist():
            for word in SENSITIVE.finditer(text or ""):
                around = text[max(0, word.start() - AROUND) : word.end() + AROUND]
                counts.update(w for w in set(IDENTIFIER.findall(around)) if like_a_name(w))
        return {"word": list(counts), "n": list(counts.values())}

    counted = map_rows(docs.select(F.col(text_col).cast("string")), make, "word string, n long")
    top = (
        counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
        .orderBy(F.desc("n"), "word").limit(DICTIONARY_WORDS).collect()
    )
    return " ".join(r["word"] for r in reversed(top)).encode()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, spans as structs (kind, start, end) in code points, end exclusive,
    by start and then by kind as listed in KINDS."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(identifiers(docs, text_col))

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        return {
            "id": batch.column(0),
            "spans": [
                [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(t or "", shared.value)]
                for t in batch.column(1).to_pylist()
            ],
        }

    return map_rows(
        docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), make,
        "id long, spans array<struct<kind: string, start: int, end: int>>",
    )
