"""Toxicity: folding, exceptions, learnt terms, held-out accuracy."""

import math
import random

import pytest

from codeloom.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def total(text, weights=None):
    lexicon = toxicity.Lexicon(weights or {"idiot": 2.0, "trash": 1.0, "vequ": 3.0})
    return toxicity.matches(lexicon.matcher(), toxicity.fold(text))[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("An IDIOT!", 2), ("1d10t", 2), ("іdiοt", 2), ("ⅰｄｉｏｔ", 2), ("id1ot, trash.", 3), ("idiots", 2),
        ("xidiot", 0), ("trash can", 0), ("a trash can and trash", 1), ("Trash  Cans", 1), ("vequa vequo", 6),
        ("", 0), ("idiot$$$ word", 2), ("in 2010 it", 0), ("id​iot", 2),
    ],
)
def test_terms_are_matched_after_folding(text, expected):
    assert total(text) == expected


def test_a_word_counts_once_with_its_heaviest_term():
    assert total("idiotic", {"idio": 1.0, "idiot": 2.0, "idiotic": 1.5}) == 2


def corpus(n=900):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    rows, labels = {}, []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(10, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = "zorv" + word() if i % 12 else "moron"
        rows[i] = " ".join(words)
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_terms_are_learnt_from_labels(spark, make_docs):
    rows, labels = corpus()
    docs = make_docs([*rows.items(), (None, "moron"), (5_000, None), (5_001, "")])
    lexicon = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
    assert "zorv" in lexicon.weights and len(lexicon.weights) <= toxicity.TERMS + len(toxicity.SEED_TERMS)
    scores = {r.id: r.score for r in toxicity.score(docs, lexicon).collect()}
    assert len(scores) == len(rows) + 3 and scores[5_000] == scores[5_001] < 0.5
    wrong = [i for i, _, t in labels if (scores[i] >= 0.7) != bool(t)]
    assert len(wrong) <= 0.02 * len(rows)


def test_without_labels_the_seed_terms_score(spark, make_docs):
    docs = make_docs({1: "you are a stupid idiot", 2: "a quiet day by the river", 3: "word " * 50_000})
    lexicon = toxicity.fit(docs, spark.createDataFrame([], LABELS))
    scores = {r.id: r.score for r in toxicity.score(docs, lexicon).collect()}
    assert scores[1] > 0.7 > 0.3 > scores[2] and scores[3] < 0.3
    assert toxicity.score(make_docs([]), lexicon).collect() == []


def test_totals_and_scores_equal_a_naive_matcher(spark):
    """Every whole document, each word against every term and phrase."""
    sf_dir = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.fit(docs, labels)
    by_length = {}
    for term, weight in lexicon.weights.items():
        by_length.setdefault(len(term), {})[term] = weight
    got = {r.id: r for r in toxicity.score(docs, lexicon).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts.items():
        words, found = toxicity.fold(text or "").split(), []
        for i, word in enumerate(words):
            phrase = [" ".join(words[i : i + n]) for n in (1, 2, 3)]
            held = [terms[word[:n]] for n, terms in by_length.items() if word[:n] in terms]
            if held and not any(p in toxicity.EXCEPTIONS for p in phrase):
                found.append(max(held))
        z = toxicity.curve_inputs([(sum(found), len(found), len(words))]) @ lexicon.curve
        row = got[doc_id]
        assert row["count"] == len(found) and row.total == pytest.approx(sum(found))
        assert row.score == pytest.approx(float(1 / (1 + math.exp(-z[0]))), abs=1e-9)
