"""Toxicity by a weighted lexicon.

Texts are folded: lower case, look-alike letters of other scripts to Latin ones,
digits and signs between letters to the letters they stand for, everything else to
single spaces.  Terms, beginnings of words, are found by one Aho-Corasick pass; a word counts
once, with its heaviest term, and not at all where an exception phrase starts.  The
sum of weights, also per word, is mapped to a probability by a logistic curve.

Terms and weights are learnt: of the beginnings of words in labelled toxic texts,
those that even a cautious estimate finds mostly in toxic texts, weighted by that
estimate.  A few plain insults are in the lexicon from the start.  At most TRAIN_ROWS
labelled rows, chosen by a hash of their id, are learnt from, and at most TERMS terms
are kept.

Defined results: null and empty texts have no terms; with no labelled row the seed
terms and a fixed curve score; rows that repeat an id are scored each for itself; a row
without an id is not held out and teaches nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.work import WorkTables
from .common import broadcast_if, learn_from, map_rows, small_batches

TRAIN_ROWS = 60_000
TERMS = 20_000
SHORTEST, LONGEST = 4, 16
CAUTION = 4.0  # observations against a term that a cautious estimate adds
LEAST_SHARE = 0.4
SEED_WEIGHT = 3.0

# fixed values: insults, phrases in which such words are harmless, look-alikes
SEED_TERMS = (
    "idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic",
    "disgusting", "worthless",
)
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "trash talk", "clown fish",
    "clownfish", "pathetic fallacy", "idiot proof", "idiot light", "sore loser", "pond scum",
    "soap scum",
)
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k",
    "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
    "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ѵ": "v", "ԛ": "q", "ԝ": "w", "ց": "g", "օ": "o", "ս": "u",
}
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_ALIKE = str.maketrans(LOOK_ALIKES)
_STAND_IN = re.compile(r"(?<=[^\W\d_])[0134570@$!]+(?=[^\W\d_])|(?<![^\W_])[0134570@$]+(?=[^\W\d_])|(?<=[^\W\d_])[013457]+(?![^\W_])")
_OTHER = re.compile(r"[\W\d_]+")
_STANDS = str.maketrans(STAND_INS)
_WIDE = re.compile("[̀-ͯ​-‍⁠﻿­℀-⅏＀-￯]|[\U0001d400-\U0001d7ff]")


def fold(text: str) -> str:
    """The text as lower-case words with one space before each and at the end."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_ALIKE)
        if _WIDE.search(text):
            text = _WIDE.sub("", unicodedata.normalize("NFKC", text).lower())
    text = _STAND_IN.sub(lambda m: m[0].translate(_STANDS), text)
    return f" {_OTHER.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    """Terms with weights and the curve from match totals to probability; bounded."""

    weights: dict[str, float]
    curve: np.ndarray = field(default_factory=lambda: np.array([-3.0, 2.0, 0.5, 0.5]))

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for phrase in EXCEPTIONS:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        for term, weight in self.weights.items():
            found.add_word(f" {term}", (len(term) + 1, weight))
        found.make_automaton()
        return found


def matches(matcher, folded: str) -> tuple[float, int, int]:
    """Sum of weights, number of matched words, number of words."""
    words: dict[int, float] = {}
    harmless = set()
    for end, (length, weight) in matcher.iter(folded):
        start = end - length + 1
        if weight is None:
            harmless.add(start)
        else:
            words[start] = max(words.get(start, 0.0), weight)
    counted = [w for start, w in words.items() if start not in harmless]
    return sum(counted), len(counted), folded.count(" ") - 1


def curve_inputs(found: list[tuple[float, int, int]]) -> np.ndarray:
    """Columns of the logistic curve; totals are also normalised by length."""
    total, count, words = (np.array(c, dtype=float) for c in zip(*found))
    words = np.maximum(words, 1)
    return np.column_stack(
        [np.ones(len(total)), np.log1p(total), np.log1p(100 * total / words), np.log1p(count)]
    )


def _learning_rows(docs, labels, id_col, text_col, most, work) -> DataFrame:
    """(text, toxic) of the labelled rows that are learnt from."""
    learn = labels.filter(
        learn_from(F.col("doc_id")) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()
    ).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    n = learn.count()
    if n > most:
        learn = learn.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        broadcast_if(learn, min(n, most)), "_id"
    )

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        return {"folded": [fold(t or "") for t in batch.column(0).to_pylist()], "toxic": batch.column(1)}

    return work.keep(map_rows(rows.select("_text", "_toxic"), make, "folded string, toxic int"), "folded")


def _beginnings(folded: str) -> set[str]:
    return {
        word[:n] for word in set(folded.split()) for n in range(SHORTEST, min(LONGEST, len(word)) + 1)
    }


def _term_counts(rows: DataFrame, known: set[str] | None) -> DataFrame:
    """(term, n): documents with a word that begins with the term; of ``known`` ones only."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        counts: Counter = Counter()
        for folded in batch.column(0).to_pylist():
            terms = _beginnings(folded)
            counts.update(terms if shared.value is None else terms & shared.value)
        return {"term": list(counts), "n": list(counts.values())}

    counted = map_rows(rows.select("folded"), make, "term string, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n"))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _weights(toxic: dict[str, int], clean: dict[str, int], base: float) -> dict[str, float]:
    """Terms whose cautious share of toxic documents is high.  Of a term and its longer
    forms with nearly as many documents the longest stands for all."""
    found = {}
    for term, n in toxic.items():
        share = n / (n + clean.get(term, 0) + CAUTION)
        if share >= LEAST_SHARE:
            found[term] = _logit(min(share, 0.999)) - _logit(base)
    longer = Counter()
    for term in found:
        longer[term[:-1]] = max(longer[term[:-1]], toxic[term])
    kept = {t: w for t, w in found.items() if longer[t] < 0.95 * toxic[t] and w > 0}
    return dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:TERMS])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    most: int = TRAIN_ROWS, work: WorkTables | None = None,
) -> Lexicon:
    small_batches(docs.sparkSession)
    work = work or WorkTables(docs.sparkSession)
    rows = _learning_rows(docs, labels, id_col, text_col, most, work)
    sizes = dict(rows.groupBy("toxic").count().collect())
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    seeds = {term: SEED_WEIGHT for term in SEED_TERMS}
    if not n_toxic or not n_clean:
        return Lexicon(seeds)
    base = n_toxic / (n_toxic + n_clean)
    least = max(3, int(0.002 * n_toxic))
    often = _term_counts(rows.filter("toxic = 1"), None).filter(F.col("n") >= least)
    toxic = dict(often.orderBy(F.desc("n"), "term").limit(10 * TERMS).collect())
    clean = dict(_term_counts(rows.filter("toxic = 0"), set(toxic)).collect())
    lexicon = Lexicon(seeds | _weights(toxic, clean, base))

    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        matcher = shared.value.matcher()
        found = [matches(matcher, t) for t in batch.column(0).to_pylist()]
        total, count, words = zip(*found)
        return {"total": total, "count": count, "words": words, "toxic": batch.column(1)}

    # at most TRAIN_ROWS rows of four numbers
    sums = map_rows(rows, make, "total double, count long, words long, toxic int").collect()
    x = curve_inputs([(r[0], r[1], r[2]) for r in sums])
    lexicon.curve = _logistic(x, np.array([r[3] for r in sums], dtype=float))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method with a small penalty, so that separable data stay finite."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - ridge * beta
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(bend, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score, total weight, number of matched words."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    ready = {}

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        if "matcher" not in ready:  # once per task
            ready["matcher"] = shared.value.matcher()
        found = [matches(ready["matcher"], fold(t or "")) for t in batch.column(1).to_pylist()]
        z = curve_inputs(found) @ shared.value.curve
        return {
            "id": batch.column(0), "score": 1 / (1 + np.exp(-np.clip(z, -30, 30))),
            "total": [f[0] for f in found], "count": [f[1] for f in found],
        }

    return map_rows(
        docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), make,
        "id long, score double, total double, count long",
    )
