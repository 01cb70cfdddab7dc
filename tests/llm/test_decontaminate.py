"""Decontamination: hits against a search for every window in every document."""

import random
import re

from pyspark.sql import functions as F

from codeloom.llm import decontaminate

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    result = set()
    for doc_id, text in docs:
        have, hits, found = words(text), set(), set()
        for item_id, item in items:
            w = words(item)
            k = min(10, len(w))
            for s in range(len(w) - k + 1 if w else 0):
                for at in range(len(have) - k + 1):
                    if have[at : at + k] == w[s : s + k]:
                        hits |= set(range(at, at + k))
                        found |= {str(item_id)} - {"None"}
        result.add((doc_id, len(have), tuple(sorted(hits)), tuple(sorted(found))))
    return result


def search(docs, bench):
    rows = decontaminate.contamination(docs, bench).collect()
    return {(r.id, r.n_words, tuple(sorted(r.hits)), tuple(r.items)) for r in rows}


def make_bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def case(seed):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice(["the", "of", "a", "Éa", "x1", "qu-o", "bb", "zz"]) for _ in range(n))
    items = [(i, some(rng.choice([1, 2, 5, 9, 10, 11, 25]))) for i in range(12)]
    items += [(50, None), (51, "..."), (3, items[4][1]), (None, some(12)), (60, "rare words only here now")]
    docs = {1: None, 2: "", 3: "!!"}
    for i in range(10, 40):
        text = some(rng.randrange(60))
        if i % 3 == 0:
            text += " " + (rng.choice(items)[1] or "").upper() + " , " + some(8)
        docs[i] = text
    docs[40] = "filler " * 40_000 + " Rare, words; only HERE now " + "filler " * 10
    return docs, items


def test_hits_equal_brute_force(spark, make_docs):
    for seed in (1, 2):
        docs, items = case(seed)
        assert search(make_docs(docs), make_bench(spark, items)) == brute(docs.items(), items)


def test_blocks_of_the_benchmark_add_up(spark, make_docs, monkeypatch):
    docs, items = case(3)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert search(make_docs(docs), make_bench(spark, items)) == brute(docs.items(), items)


def test_empty_tables_and_repeated_ids(spark, make_docs):
    text = "one two three four five six seven eight nine ten eleven"
    bench = make_bench(spark, [(7, text)])
    assert search(make_docs([]), bench) == set()
    docs = make_docs([(1, text), (1, "other words"), (None, text)])
    assert search(docs, bench.limit(0)) == {(1, 11, (), ()), (1, 2, (), ()), (None, 11, (), ())}
    hit = tuple(range(11))
    assert search(docs, bench) == {(1, 11, hit, ("7",)), (1, 2, (), ()), (None, 11, hit, ("7",))}
    clean = decontaminate.drop_contaminated(docs.withColumn("hits", F.lit(1)), bench).collect()
    assert [(r.doc_id, r.text, r.hits) for r in clean] == [(1, "other words", 1)]


def test_proximity_allows_words_between(spark, make_docs):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
    docs = make_docs({
        1: item, 2: item.replace("echo", "echo um"), 3: "alpha " + "x " * 50 + "juliet", 4: "nothing",
    })
    rows = decontaminate.contamination(docs, make_bench(spark, [(1, item)])).collect()
    assert {r.id: (len(r.hits), r.n_near) for r in rows} == {1: (10, 1), 2: (0, 1), 3: (0, 0), 4: (0, 0)}


def wide(spark, docs, path):
    names = ["_file", "_row", "file", "row", "file0", "row0", "id", "_id", "_text", "digest", "keeper", "items"]
    docs.selectExpr("*", *[f"'x' AS {n}" for n in names]).write.parquet(path)
    return spark.read.parquet(path)


def test_columns_of_any_name_may_stand_beside(spark, make_docs, tmp_path):
    docs, items = case(3)
    table, bench = wide(spark, make_docs(docs), str(tmp_path / "wide")), make_bench(spark, items)
    expected = brute(docs.items(), items)
    assert search(table, bench) == expected
    kept = decontaminate.drop_contaminated(table, bench)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, hits, _ in expected if not hits}


def test_repetitive_texts_do_not_multiply(spark, make_docs, monkeypatch):
    docs = {1: "a " * 1000, 2: "b a " * 500, 3: "a " * 9 + "b", 4: "c " * 50}
    items = [(1, "a " * 200), (2, "a b " * 100), (3, "a " * 9 + "b"), (4, "d " * 20)]
    asked = []
    listed = decontaminate.alignments

    def spy(index, anchors):
        found = listed(index, anchors)
        asked.append(found[0].count())
        return found

    monkeypatch.setattr(decontaminate, "alignments", spy)
    assert search(make_docs(docs), make_bench(spark, items)) == brute(docs.items(), items)
    assert asked[0] < 10_000  # 192,000 places of one word in document 1 and item 1 alone


def test_proximity_matches_are_checked_on_the_words(spark, make_docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = {
        1: "x " * 5 + item, 2: item.replace("epsilon", "epsilon so"), 3: item.replace("zeta eta", "eta zeta"),
        4: item.replace("gamma", "other"), 5: " ".join(reversed(item.split())),
        6: item.replace("epsilon", "epsilon " + "so " * 5), 7: "nothing of it",
    }
    rows = decontaminate.contamination(make_docs(docs), make_bench(spark, [(1, item)])).collect()
    got = {r.id: (len(r.items), r.n_near) for r in rows}
    assert got == {1: (1, 1), 2: (0, 1), 3: (0, 1), 4: (0, 0), 5: (0, 0), 6: (0, 0), 7: (0, 0)}


def test_benchmark_in_several_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    docs, items = case(4)
    assert search(make_docs(docs), make_bench(spark, items)) == brute(docs.items(), items)
