"""Exact dedup: groups against a dictionary of whole texts, weak digests, streams."""

import hashlib
import re

from pyspark.sql import functions as F

from codeloom.functions.work import WorkTables
from codeloom.llm import dedup
from codeloom.llm.common import placed_rows

TEXTS = {
    5: "a  b\n c", 3: "a b c", 9: "a\tb\r\nc", 4: "A b c", 1: None, 2: "", 7: " ", 8: "\x0b\x0c",
    10: "a b c", 11: "long " * 50_000, 12: "long " * 50_000, 13: "a b c ",
}


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    return {
        (i, min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())
        for t, ids in groups.items() for i in ids
    }


def found(docs, **more):
    rows = dedup.exact_groups(docs, **more).select(
        "id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("sha")
    ).collect()
    return [tuple(r) for r in rows]


def test_groups_equal_brute_force(make_docs):
    got = found(make_docs(TEXTS))
    assert len(got) == len(TEXTS)
    assert set(got) == brute(TEXTS.items())


def test_texts_with_one_digest_are_told_apart_by_their_bytes(make_docs):
    """With a digest without bytes everything collides."""
    rows = {i: f"text {i % 7}" for i in range(40)}

    def weak(text):
        return F.substring(F.unhex(F.sha2(text, 256)), 1, 0)

    got = {(r[0], r[1], r[2], r[3]) for r in found(make_docs(rows), digest=weak)}
    assert got == {x[:4] for x in brute(rows.items())}


def test_repeated_rows_keep_one_and_rows_without_id_come_last(make_docs):
    docs = make_docs([(1, "x"), (1, "x"), (None, "y"), (6, "y"), (None, "z"), (None, "z")])
    kept = sorted((r[0] or 0) for r in found(docs) if r[3])
    assert kept == [0, 1, 6]
    assert sorted((r.doc_id or 0) for r in dedup.drop_copies(docs).collect()) == kept


def test_empty_table_and_clashing_columns(spark, make_docs):
    assert found(make_docs([])) == []
    docs = make_docs({1: "x", 2: "x"}).withColumn("kept", F.lit(5)).withColumn("digest", F.lit("d"))
    rows = dedup.drop_copies(docs).collect()
    assert [r.asDict() for r in rows] == [
        {"doc_id": 1, "text": "x", "lang": "en", "source": "s", "n_chars": 1, "kept": 5, "digest": "d"}
    ]


def test_frames_without_files_are_written_first(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("text"))
    assert sorted(r.doc_id for r in dedup.drop_copies(docs).collect()) == [0, 1]


def test_later_files_meet_the_state_of_earlier_ones(spark, make_docs):
    work = WorkTables(spark)
    path, state, updates = (f"{work.folder}/{n}" for n in ("prints", "state", "updates"))

    def add(rows, folder):
        docs = placed_rows(make_docs(rows, folder), _id=F.col("doc_id"), _text=F.col("text")).selectExpr(
            "_id", "_text", "file _file", "row _row"
        )
        dedup.fingerprints(docs).write.mode("append").parquet(path)
        got = dedup.stream_state(spark, path, state, updates, files=1)
        return {r.keeper.id: r.group_size for r in got.collect()}

    assert add({5: "x", 6: "x", 7: "y"}, "one") == {5: 2, 7: 1}
    assert add({3: "x", 8: "z"}, "two") == {3: 3, 7: 1, 8: 1}


def test_columns_of_any_name_may_stand_beside(spark, make_docs, tmp_path):
    names = ["_file", "_row", "file", "row", "file0", "row0", "id", "_id", "_text", "digest", "keeper", "first"]
    docs = make_docs({1: "a  b", 2: "a b", 3: None, 4: "", 5: "c"})
    path = str(tmp_path / "wide")
    docs.selectExpr("*", *[f"'x' AS {n}" for n in names]).write.parquet(path)
    table = spark.read.parquet(path)
    kept = dedup.drop_copies(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5]
