"""BPE: ids and texts against the tokenizer itself."""

import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codeloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    *"ab '.,!\n\t\r\x0b\x0c\x1c\x85\xa0　 ​﻿é中😀019sdtrevlm", "<|endoftext|>", "<|", "|>", "'s",
    "'ll", "  ", "é", " word", "\n\n\n",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_words_give_the_ids_of_the_whole_text(tokenizer):
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(25)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        words = bpe.WORD.findall(text)
        assert "".join(words) == text
        assert b"".join(bpe._encoded(PATH, words)) == np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("most", [0, 3, 400_000])
def test_documents_round_trip_whatever_the_size_of_the_table(make_docs, tokenizer, most):
    rng = random.Random(7)
    rows = {i: "".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for i in range(30)}
    rows |= {40: None, 41: "", 42: "same words " * 30_000, 43: "x" * 300_000}
    docs = make_docs([*rows.items(), (1, rows[1]), (None, "no id")])
    got = bpe.decode(bpe.encode(docs, PATH, most=most), PATH).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        text = "no id" if r.id is None else rows[r.id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert r.text == text


def test_empty_table(make_docs):
    assert bpe.encode(make_docs([]), PATH).collect() == []


def test_pieces_spell_every_id(tokenizer):
    pieces = bpe.pieces(PATH)
    assert len(pieces) == tokenizer.get_vocab_size() == 50_257
    assert pieces[50_256] == b"<|endoftext|>"
    assert b"".join(pieces[i] for i in tokenizer.encode("héllo\n wörld").ids).decode() == "héllo\n wörld"


def test_pipeline_encodes_and_decodes_in_one_pass(spark, make_docs):
    rows = {1: "a b <|endoftext|>", 2: None, 3: "", 4: "é中😀 " * 50, 5: "rare" * 30}
    docs = make_docs([*rows.items(), (1, "again"), (None, "no id")])
    one = bpe.round_trip(docs, PATH, most=3)
    both = bpe.decode(bpe.encode(docs, PATH, most=3), PATH)
    assert sorted(map(str, one.collect())) == sorted(map(str, both.collect()))
    # a task holds one Python worker with the vocabulary
    plan = corpus_pipeline.encoding(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
