"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from codeloom.llm import lexical
from codeloom.llm.lexical import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(docs, items, best):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 100 - 25 + 25 * sum(c.values()) * n // words
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in terms(text) if c[t]
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(scores)[:best], 1):
            out.append((item, rank, None if none else i, -score))
    return sorted(out, key=str)


def table(spark, make_docs, docs):
    # names that the operator uses itself
    extra = make_docs(docs)
    path = extra.inputFiles()[0].rsplit("/", 1)[0] + "-extra" if docs else None
    if path:
        extra.selectExpr("*", "1 AS file", "2 AS row", "'x' AS _file", "3 AS id", "4 AS items").write.parquet(path)
        extra = spark.read.parquet(path)
    return extra


def got(spark, docs_table, items, **options):
    rows = spark.createDataFrame([(i, t, 5, "z") for i, t in items], "item_id long, text string, place int, block string")
    found = search(docs_table, rows, **options).collect()
    return sorted(((r.item_id, r["rank"], r.id, r.score) for r in found), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [rng.choice(["", "x", "É", "9"]) + "".join(rng.choices("abcdeABC", k=rng.randint(1, 4))) for _ in range(300)]
    weights = [1 / (i + 1) for i in range(300)]

    def text(length):
        return "".join(w + rng.choice(" .,\n-") for w in rng.choices(words, weights, k=length))

    return [(i, text(rng.choice([1, 5, 40, 400]))) for i in range(n)], [(i, text(rng.randint(1, 30))) for i in range(25)]


@pytest.mark.parametrize("probes, bits", [(4, 16), (1, 1)])
def test_ranks_equal_scoring_everything(spark, make_docs, monkeypatch, probes, bits):
    # with one bit a key the bounds are loose: nothing may be lost by that
    monkeypatch.setattr(lexical, "PROBES", probes)
    monkeypatch.setattr(lexical, "BITS_PER_KEY", bits)
    docs, items = corpus(probes, 300)
    assert got(spark, table(spark, make_docs, docs), items, best=7) == brute(docs, items, 7)


def test_copies_ties_nulls_and_repeats(spark, make_docs):
    docs = [(i, "Alpha beta, gamma" if i % 3 else "alpha delta") for i in range(60)]
    docs += [(None, "alpha beta gamma"), (None, None), (70, ""), (71, "..."), (5, "alpha beta gamma"), (5, "alpha beta gamma")]
    docs += [(80, "omega " * 30_000)]
    items = [(1, "alpha beta beta"), (1, "gamma"), (2, None), (3, ""), (4, "unknown"), (5, "omega alpha"), (None, "beta")]
    assert got(spark, table(spark, make_docs, docs), items, best=20) == brute(docs, items, 20)


def test_items_in_several_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 300)
    monkeypatch.setattr(lexical, "ITEM_CHUNK", 2)
    docs, items = corpus(3, 60)
    assert got(spark, table(spark, make_docs, docs), items, best=3) == brute(docs, items, 3)


def test_empty_tables(spark, make_docs):
    docs, items = corpus(4, 10)
    assert got(spark, make_docs([]), items) == []
    assert got(spark, make_docs([(1, None)]), items) == []
    assert got(spark, make_docs(docs), []) == []


def test_documents_that_cannot_rank_are_not_scored(spark, make_docs, monkeypatch):
    docs, items = corpus(5, 400)
    asked = []
    scored = lexical._scored

    def spy(placed, chosen, *rest):
        asked.append(chosen.selectExpr("sum(size(items))").first()[0])
        return scored(placed, chosen, *rest)

    monkeypatch.setattr(lexical, "_scored", spy)
    assert got(spark, make_docs(docs), items, best=3) == brute(docs, items, 3)
    assert asked[1] < 400 * 25 / 4
