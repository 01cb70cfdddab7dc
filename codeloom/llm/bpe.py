"""Byte-level BPE by a distinct-word table.

Texts are split in Spark into words: a run of white space with the run of other
characters behind it.  A byte-level tokenizer never merges across the start of such
a word, so a text's ids are its words' ids in order.  Words are counted over all
documents and each one in the table is encoded once; the ids are joined back at each
position.  Decoding joins each id to its piece of bytes.

The table side of the join is broadcast, so it is held to TABLE_WORDS, the most
frequent words.  Positions of rarer words would have to be shuffled together with
their texts (more than the input's size on disk); they are encoded where they stand,
each distinct one once per batch.  No word is left out, whatever its frequency.

Defined results: null and empty text have no ids and decode to the empty text; a
special token's string in a text becomes that token, as in the tokenizer; repeated
rows are encoded each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.work import WorkTables
from .common import give_back, map_rows, small_batches

TABLE_WORDS = 200_000
_LONGEST_IN_TABLE = 64
_COUNTED = 200_000

# white space in the sense of the tokenizer's pattern (Unicode White_Space)
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _encoded(path: str, words: list[str]) -> list[bytes]:
    """Ids of each word as little-endian 32-bit numbers."""
    found = _tokenizer(path).encode_batch_fast(words, add_special_tokens=False)
    return [np.array(e.ids, dtype="<u4").tobytes() for e in found]


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """Bytes of each id.  Byte-level vocabularies spell a byte as one printable
    character: itself where it is printable, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(0x100 + i): b for i, b in enumerate(others)}
    tokenizer = _tokenizer(path)
    return [
        bytes(byte_of[c] for c in tokenizer.id_to_token(i))
        for i in range(tokenizer.get_vocab_size())
    ]


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all documents, counted within each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())}
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(WORD.findall(text))
                if len(counts) > _COUNTED:
                    yield out()
                    counts.clear()
        yield out()
        counts.clear()
        give_back()

    return (
        docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n"))
    )


def word_table(counts: DataFrame, path: str, most: int = TABLE_WORDS) -> DataFrame:
    """(word, ids) of the most frequent words, at most ``most``."""
    short = counts.filter(F.char_length("word") <= _LONGEST_IN_TABLE)
    # words by powers of 2^(1/4) of their count: a few hundred steps at any size
    step = F.floor(F.log2("n") * 4).cast("int")
    steps = sorted(short.groupBy(step.alias("step")).count().collect(), reverse=True)
    least, total = None, 0
    for number, words in steps:
        if (total := total + words) > most:
            break
        least = number
    chosen = short.filter(step >= least) if least is not None else short.limit(0)

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        words = batch.column(0).to_pylist()
        return {"word": words, "ids": _encoded(path, words)}

    return map_rows(chosen.select("word"), make, "word string, ids binary")


def _word_ids(docs: DataFrame, path: str, text_col: str, most: int, work: WorkTables | None):
    """The word table, broadcast."""
    work = work or WorkTables(docs.sparkSession)
    counts = work.keep(word_counts(docs, text_col), "words")
    table = work.keep(word_table(counts, path, most), "word-ids").toArrow()
    return docs.sparkSession.sparkContext.broadcast(
        dict(zip(table.column("word").to_pylist(), table.column("ids").to_pylist()))
    )


def _ids_of(texts: pa.Array, ids_of: dict[str, bytes], path: str) -> list[bytes]:
    split = [WORD.findall(t) if t else [] for t in texts.to_pylist()]
    missing = list({w for words in split for w in words if w not in ids_of})
    rare = dict(zip(missing, _encoded(path, missing)))
    return [
        b"".join([ids_of[w] if w in ids_of else rare[w] for w in words]) for words in split
    ]


def _texts_of(all_ids: list[bytes], path: str) -> list[str]:
    piece = pieces(path)
    return [
        b"".join([piece[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        for ids in all_ids
    ]


def encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    most: int = TABLE_WORDS, work: WorkTables | None = None,
) -> DataFrame:
    """Per row: id, ids (little-endian unsigned 32-bit numbers, packed)."""
    small_batches(docs.sparkSession)
    known = _word_ids(docs, path, text_col, most, work)

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        return {"id": batch.column(0), "ids": _ids_of(batch.column(1), known.value, path)}

    return map_rows(
        docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")),
        make, "id long, ids binary",
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the text that its ids spell."""

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        return {
            "id": batch.column(0), "ids": batch.column(1),
            "text": _texts_of(batch.column(1).to_pylist(), path),
        }

    return map_rows(encoded.select("id", "ids"), make, "id long, ids binary, text string")


def round_trip(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    most: int = TABLE_WORDS, work: WorkTables | None = None,
) -> DataFrame:
    """What ``decode`` gives of ``encode``'s rows, in one pass: a task then holds one Python
    worker with the vocabulary, not one for each way."""
    small_batches(docs.sparkSession)
    known = _word_ids(docs, path, text_col, most, work)

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        ids = _ids_of(batch.column(1), known.value, path)
        return {"id": batch.column(0), "ids": ids, "text": _texts_of(ids, path)}

    return map_rows(
        docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")),
        make, "id long, ids binary, text string",
    )
