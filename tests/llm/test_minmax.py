"""Near duplicates: components against exact pairwise similarity."""

import random

import numpy as np
import pytest

from codeloom.llm import minmax
from codeloom.llm.shingles import shingle_set


def brute(rows, percent):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        n = len(words)
        sets[i] = {tuple(words[j : j + 5]) for j in range(n - 4)} if n >= 5 else {tuple(words)} - {()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {(i, len(sets[i]), find(i)) for i in sets}


def found(docs, percent=80):
    return {(r.id, r.n_shingles, r.component) for r in minmax.near_duplicates(docs, percent).collect()}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = {1: None, 2: "", 3: " \n\t", 4: "one two", 5: "One  TWO", 6: "one two three", 7: "a b c d e"}
    base = [word() for _ in range(80)]
    for i in range(20, 60):  # a chain of edits and a star of edits
        text = list(base)
        for _ in range(i % 4):
            text[rng.randrange(80)] = word()
        rows[i] = " ".join(text)
    step = list(base)
    for i in range(60, 75):
        step[(i * 5) % 80] = word()
        rows[i] = " ".join(step)
    for i in range(80, 100):
        rows[i] = " ".join(word() for _ in range(rng.randrange(3, 200)))
    rows[100] = " ".join(word() for _ in range(30_000))
    rows[101] = rows[100] + " end"
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_brute_force(make_docs, percent):
    rows = corpus()
    assert found(make_docs(rows), percent) == brute(rows.items(), percent)


def test_only_the_smallest_of_a_component_stays(make_docs):
    rows = corpus(2)
    heads = {c for _, _, c in brute(rows.items(), 80)}
    kept = minmax.keep_one(make_docs(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(heads)


def test_rows_without_id_repeated_rows_and_empty_tables(make_docs):
    text = "a b c d e f g"
    docs = make_docs([(None, text), (4, text), (4, text), (9, text), (None, None)])
    got = sorted(((r.id or 0), r.component or 0) for r in minmax.near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 0), (4, 4), (4, 4), (9, 4)]
    assert found(make_docs([], "empty")) == set()


def test_signatures_estimate_similarity_from_both_ends():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    b = np.concatenate([a[300:], rng.integers(0, 2**63, 300).astype(np.uint64)])
    same = minmax.signature(a) == minmax.signature(np.unique(b))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(same[:64].mean() - true) < 0.2 and abs(same[64:].mean() - true) < 0.2
    assert abs(same.mean() - true) < 0.12


def test_words_split_at_ascii_white_space_only():
    assert len(shingle_set("a b c\x0bd\x1ce f".encode())) == 1
    assert len(shingle_set("Éa b c d e f".encode())) == 2
    assert list(shingle_set(b"A B c")) == list(shingle_set(b"a b\tC"))


def test_an_id_with_several_texts_links_with_all_that_they_link_with(make_docs):
    rng = random.Random(5)
    a, b, c = (" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(99)) for _ in range(60)) for _ in range(3))
    rows = [(1, a + " q"), (1, b + " q"), (2, a), (3, b), (4, c), (5, c + " q"), (4, b)]
    got = sorted((r.id, r.component) for r in minmax.near_duplicates(make_docs(rows)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (4, 1), (5, 1)]


@pytest.mark.parametrize("edits, percent", [(4, 85), (5, 80)])
def test_a_crowd_on_one_template_is_not_compared_pair_by_pair(make_docs, monkeypatch, edits, percent):
    rng = random.Random(edits)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = {}
    for i in range(150):
        text = list(base)
        for at in rng.sample(range(200), edits):
            text[at] = f"own{i}x{at}"
        rows[i] = " ".join(text)
    rows[200] = rows[7] + " end"  # links with 7 only
    asked = {}
    confirmed = minmax._confirmed

    def spy(pairs, sets, percent, work, name):
        asked[name] = pairs.count()
        return confirmed(pairs, sets, percent, work, name)

    monkeypatch.setattr(minmax, "_confirmed", spy)
    assert found(make_docs(rows), percent) == brute(rows.items(), percent)
    assert asked["rest-pairs"] < 2 * 150  # of 11,175


def test_columns_of_any_name_may_stand_beside(spark, make_docs, tmp_path):
    rows = corpus(3)
    path = str(tmp_path / "wide")
    names = ["_file", "_row", "id", "rep", "band", "_id", "_text", "_gone", "set_hash", "n"]
    make_docs(rows).selectExpr("*", *[f"'x' AS {n}" for n in names]).write.parquet(path)
    docs = spark.read.parquet(path)
    assert found(docs) == brute(rows.items(), 80)
    kept = minmax.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in brute(rows.items(), 80)}
