"""Registered queries and the pipeline on the smallest tables."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from compare import compare, connect
from tokenizers import Tokenizer

from codeloom.llm.queries import REGISTERED

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n, (_, check) in REGISTERED.items() if check])
def test_query_equals_check(spark, con, name):
    run, check = REGISTERED[name]
    problem, rows = compare(spark, con, SF_DIR, run, check)
    assert problem is None and rows > 0


@pytest.mark.parametrize("name", ["op3_secret_scan", "op8_sharding", "op6_quality", "op9_toxicity"])
def test_one_row_per_document(spark, name):
    ids = [r.doc_id for r in REGISTERED[name][0](spark, SF_DIR).collect()]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert sorted(ids) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_bpe_equals_the_tokenizer(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = REGISTERED["op5_bpe"][0](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_most_turns_of_conversations_are_recovered(spark):
    table = {(r.conv_id, r.turn): r.role for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()}
    got = {(r.conv_id, r.turn): r.role for r in REGISTERED["op1_chat_format"][0](spark, SF_DIR).collect()}
    assert sum(got.get(k) == role for k, role in table.items()) > 0.85 * len(table)


def test_pipeline_stages_act_on_what_came_before(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = [docs.count()]
    from codeloom.functions.work import WorkTables

    work = WorkTables(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = work.keep(stage(spark, docs, SF_DIR), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(docs.count())
    assert all(a > b > 0 for a, b in zip(kept[:2], kept[1:3])) and kept[4] < kept[3] <= kept[2]
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert {r.doc_id for r in final} == {r.doc_id for r in docs.collect()}
    again = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {(r.doc_id, r.ids_sha256) for r in again} == {(r.doc_id, r.ids_sha256) for r in final}


