"""Ranked lexical search over bit-sliced Bloom signatures.

Each document has a signature: of every term, and again of the term with each of
LEVELS that its count reaches, PROBES bits are set.  Signatures of documents of like size form
blocks, stored by bit position: a slice is a bitmap over the block's documents.  The
slices of a term, and-ed, mark every document that holds it and some that do not, so that the sums
of term weights over marked documents, times the largest share that a term of that count
level can have in a document of that length, are upper bounds of scores.

A search counts the items' terms, takes bounds from the slices, scores the documents
with the highest bounds exactly, which gives each item a threshold, and then scores
exactly, on their whole texts, all documents whose bound reaches it.  No other document can
be among the best, so results are those of scoring everything.

Items are taken in blocks of ITEM_BYTES, whose terms and weights go to all tasks.  Each
task keeps the best of its own rows per item, so that no item's candidates are gathered.

Defined results: a null or empty text, or one without terms, is in no result; every row is
a document, also where identifiers repeat; rows without an identifier come last among equal
scores; every item row is an item of its own, without terms it has no results; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.work import WorkTables
from .common import arrow_schema, bounded_batches, broadcast_if, filed, item_blocks, placed_rows, text_bytes
from .shingles import mix, word_numbers

BEST = 20
# Lower ends of the classes of term counts that a signature tells apart.
LEVELS = (1, 2, 3, 4, 6, 9, 17)
PROBES = 4
BITS_PER_KEY = 16
# A block holds so many documents, or bits, or eight documents; longer signatures than MOST_BITS are
# not made wider, which costs precision but no result.
BLOCK_DOCS = 4096
BLOCK_BITS = 1 << 22
MOST_BITS = 1 << 22
# Texts of one block of items, give or take ITEM_CHUNK of them.
ITEM_BYTES = 1 << 20
ITEM_CHUNK = 16
# Bounds are taken for so many (term or item, document) pairs at a time.
_PAIRS = 1 << 24
# Final rows meet in two steps, so that one item's rows of all tasks need not.
_SALTS = 32

_TERM_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
_INDEX = "width int, n array<long>, most array<long>, id array<long>, file array<string>, row array<long>, slices binary"


def terms(text: bytes) -> list[bytes]:
    """Runs of digits, letters and everything beyond ASCII, with A-Z in lower case."""
    return text.translate(_TERM_BYTES).split()


def _slices(numbers: np.ndarray, level: int, width: int) -> np.ndarray:
    """Bit positions, one row of PROBES per term number, of a count level."""
    key = mix(numbers + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1)))
    step = (key >> np.uint64(32)) | np.uint64(1)
    at = key[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]
    return (at & np.uint64(width - 1)).astype(np.int64)


class _Block:
    """Documents of one signature width, until their slices are made."""

    def __init__(self, width: int):
        self.width = width
        self.room = max(8, min(BLOCK_DOCS, BLOCK_BITS // width))
        self.docs: list[tuple] = []
        self.numbers: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def record(self) -> dict:
        n, most, ids, files, rows = zip(*self.docs)
        numbers, counts = np.concatenate(self.numbers), np.concatenate(self.counts)
        doc = np.repeat(np.arange(len(self.docs)), [len(c) for c in self.counts])
        padded = -(-len(self.docs) // 8) * 8
        bits = np.zeros(self.width * padded, dtype=np.uint8)
        for level, least in enumerate(LEVELS):
            held = counts >= least
            at = _slices(numbers[held], level, self.width) * padded + doc[held, None]
            bits[at.ravel()] = 1
        slices = np.packbits(bits.reshape(self.width, padded), axis=1).tobytes()
        return {"width": self.width, "n": n, "most": most, "id": ids, "file": files, "row": rows, "slices": slices}


def build_index(docs: DataFrame) -> DataFrame:
    """Blocks of signatures, from rows (id, text, file, row); nothing is shuffled."""
    fields = arrow_schema(docs.sparkSession, _INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, _Block] = {}

        def out(block: _Block) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([block.record()], schema=fields)

        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("id", "file", "row")))
            for place, text in zip(places, text_bytes(batch.column("text"))):
                words = terms(text)
                if not words:
                    continue
                counted = Counter(words)
                counts = np.fromiter(counted.values(), dtype=np.int64, count=len(counted))
                keys = sum(int((counts >= least).sum()) for least in LEVELS)
                width = min(MOST_BITS, max(64, 1 << (keys * BITS_PER_KEY * 3 // 4 - 1).bit_length()))
                block = blocks.setdefault(width, _Block(width))
                block.docs.append((len(words), int(counts.max()), *place))
                block.numbers.append(word_numbers(list(counted)))
                block.counts.append(counts)
                if len(block.docs) == block.room:
                    yield out(blocks.pop(width))
        for block in blocks.values():
            yield out(block)
        pa.default_memory_pool().release_unused()

    return docs.select("id", "text", "file", "row").mapInArrow(run, _INDEX)


def document_frequencies(docs: DataFrame, wanted: list[bytes]) -> list[int]:
    """In how many documents each of the wanted terms stands."""
    place = {t: i for i, t in enumerate(wanted)}
    schema = "term int, df long"
    fields = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in text_bytes(batch.column("text")):
                found.update(place.keys() & set(terms(text)))
        if found:
            columns = [[place[t] for t in found], list(found.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    frequencies = [0] * len(wanted)
    # one row per wanted term at most
    for r in docs.select("text").mapInArrow(run, schema).groupBy("term").agg(F.sum("df").alias("df")).collect():
        frequencies[r.term] = r.df
    return frequencies


@dataclass
class Queries:
    """One block of items: their known terms with weights, and the corpus counts."""

    known: list[bytes]
    weights: np.ndarray
    items: list[tuple[np.ndarray, np.ndarray]]  # places in ``known``, weight times repeats
    documents: int
    words: int

    def lengths(self, n: list[int]) -> np.ndarray:
        """m of documents with n terms."""
        return np.array([75 + 25 * x * self.documents // self.words for x in n], dtype=np.int64)


def share(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * count) // np.maximum(1000 * count + 12 * m, 1)


def make_queries(docs: DataFrame, texts: list[str | None], documents: int, words: int) -> Queries:
    counted = [Counter(terms((t or "").encode())) for t in texts]
    wanted = sorted(set().union(*counted))
    frequencies = document_frequencies(docs, wanted)
    known = [t for t, df in zip(wanted, frequencies) if df]
    weights = np.array(
        [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequencies if df],
        dtype=np.int64,
    )
    place = {t: i for i, t in enumerate(known)}
    items = []
    for counts in counted:
        own = [(place[t], c) for t, c in counts.items() if t in place]
        at = np.array([p for p, _ in own], dtype=np.int64)
        items.append((at, weights[at] * np.array([c for _, c in own], dtype=np.int64)))
    return Queries(known, weights, items, documents, words)


class _Bounds:
    """Upper bounds of all items' scores in a block of the index."""

    def __init__(self, queries: Queries):
        self.queries = queries
        self.numbers = word_numbers(queries.known)
        self.places: dict[tuple[int, int], np.ndarray] = {}

    def of(self, width: int, n: list[int], most: list[int], matrix: np.ndarray) -> np.ndarray:
        docs, queries = len(n), self.queries
        m, most = queries.lengths(n), np.array(most, dtype=np.int64)
        bounds = np.zeros((len(queries.items), docs), dtype=np.int64)
        held, below, marks = np.arange(len(queries.known)), np.zeros(docs, dtype=np.int64), None
        at = np.arange(len(queries.known))  # a term's row among those still held, -1 for none
        for level in range(len(LEVELS)):
            if (level, width) not in self.places:
                self.places[level, width] = _slices(self.numbers, level, width)
            where = self.places[level, width][held]
            marked = matrix[where[:, 0]]
            for probe in range(1, PROBES):
                marked &= matrix[where[:, probe]]
            if marks is not None:
                marked &= marks
            some = marked.any(axis=1)
            held, marks = held[some], marked[some]
            if not len(held):
                break
            at = np.full(len(queries.known), -1)
            at[held] = np.arange(len(held))
            top = most if level + 1 == len(LEVELS) else np.minimum(most, LEVELS[level + 1] - 1)
            upper = np.where(most >= LEVELS[level], share(top, m), below)
            rise, below = upper - below, upper
            bits = np.unpackbits(marks, axis=1, count=docs)
            for i, (places, weights) in enumerate(queries.items):
                own = at[places]
                here = own >= 0
                if here.any():
                    # whole numbers below 2^53: exact
                    sums = weights[here].astype(np.float64) @ bits[own[here]].astype(np.float64)
                    bounds[i] += sums.astype(np.int64) * rise
        return bounds


def _blocks(batches: Iterator[pa.RecordBatch], queries: Queries):
    """(columns of some documents, all items' bounds for them)."""
    bounds = _Bounds(queries)
    step = max(1, _PAIRS // max(len(queries.known), len(queries.items), 1) // 8)
    for batch in batches:
        for block in batch.to_pylist():
            matrix = np.frombuffer(block["slices"], dtype=np.uint8).reshape(block["width"], -1)
            for at in range(0, matrix.shape[1], step):
                docs = {c: block[c][8 * at : 8 * (at + step)] for c in ("n", "most", "id", "file", "row")}
                yield docs, bounds.of(block["width"], docs["n"], docs["most"], matrix[:, at : at + step])


def _highest_bounds(index: DataFrame, queries: Queries, best: int) -> DataFrame:
    """(item, bound, file, row): each task's highest bounds."""
    schema = "item int, score long, file string, row long"
    fields = arrow_schema(index.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[list] = [[] for _ in queries.items]
        for block, bounds in _blocks(batches, queries):
            n = min(best, bounds.shape[1])
            highest = np.argpartition(bounds, -n, axis=1)[:, -n:]
            for i, docs in enumerate(highest):
                for d in docs:
                    entry = (int(bounds[i, d]), block["file"][d], block["row"][d])
                    if entry[0] <= 0:
                        continue
                    if len(top[i]) < best:
                        heapq.heappush(top[i], entry)
                    elif entry > top[i][0]:
                        heapq.heapreplace(top[i], entry)
        rows = [(i, *entry) for i, own in enumerate(top) for entry in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    return index.mapInArrow(run, schema)


def _not_excluded(index: DataFrame, queries: Queries, least: list[tuple[int, int | None]]) -> DataFrame:
    """(file, row, items): documents whose bound reaches an item's threshold; one that just
    equals it only with an identifier up to that of the threshold."""
    schema = "file string, row long, items array<int>"
    scores = np.array([max(score, 1) for score, _ in least], dtype=np.int64)[:, None]
    last = np.array([np.iinfo(np.int64).max if i is None else i for _, i in least], dtype=np.int64)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = arrow_fields
        for block, bounds in _blocks(batches, queries):
            ids = np.array([np.iinfo(np.int64).max if i is None else i for i in block["id"]], dtype=np.int64)
            open_ = (bounds > scores) | ((bounds == scores) & (ids[None, :] <= last))
            docs = np.flatnonzero(open_.any(axis=0))
            if len(docs):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block["file"][d] for d in docs], pa.string()),
                        pa.array([block["row"][d] for d in docs], pa.int64()),
                        pa.array([np.flatnonzero(open_[:, d]) for d in docs], fields.field("items").type),
                    ],
                    schema=fields,
                )

    arrow_fields = arrow_schema(index.sparkSession, schema)
    return index.mapInArrow(run, schema)


def _scored(docs: DataFrame, chosen: DataFrame, queries: Queries, best: int) -> DataFrame:
    """(item, id, score): exact scores above 0 of chosen (file, row, items), the best of each task."""
    schema = "item int, id long, score long"
    fields = arrow_schema(docs.sparkSession, schema)
    place = {t: i for i, t in enumerate(queries.known)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[list] = [[] for _ in queries.items]
        for batch in batches:
            columns = (batch.column("id").to_pylist(), batch.column("items").to_pylist())
            for key, items, text in zip(*columns, text_bytes(batch.column("text"))):
                words = terms(text)
                counts = np.zeros(len(place), dtype=np.int64)
                for term, count in Counter(words).items():
                    if (at := place.get(term)) is not None:
                        counts[at] = count
                shares = share(counts, queries.lengths([len(words)]))
                for i in items:
                    places, weights = queries.items[i]
                    score = int(weights @ shares[places])
                    # smaller identifiers are better, null the worst
                    entry = (score, key is not None, -key if key is not None else 0)
                    if score <= 0:
                        continue
                    if len(top[i]) < best:
                        heapq.heappush(top[i], entry)
                    elif entry > top[i][0]:
                        heapq.heapreplace(top[i], entry)
        rows = [
            (i, -key if known else None, score) for i, own in enumerate(top) for score, known, key in own
        ]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    n = chosen.count()
    met = docs.join(broadcast_if(chosen, n), ["file", "row"])
    return met.select("id", "text", "items").mapInArrow(run, schema)


def _first(rows: DataFrame, best: int, salt: str, *ties: str) -> DataFrame:
    """Each item's first rows by falling score, then ``ties``, with their ``rank``."""
    order = [F.col("score").desc(), *[F.col(c).asc_nulls_last() for c in ties]]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(_SALTS)))
    within = W.partitionBy("item", "_salt").orderBy(*order)
    over = W.partitionBy("item").orderBy(*order)
    few = salted.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= best)
    return few.drop("_salt").withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= best)


def search(
    docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", work: WorkTables | None = None,
) -> DataFrame:
    """(item_id, rank, id, score): each item's ``best`` documents."""
    spark = docs.sparkSession
    work = work or WorkTables(spark)
    placed = placed_rows(filed(docs, work), id=F.col(id_col).cast("long"), text=F.col(text_col))
    blocks, n_blocks = item_blocks(items, item_col, item_text_col, work, ITEM_BYTES, ITEM_CHUNK)
    item_type = blocks.schema["item_id"].dataType.simpleString()
    with bounded_batches(spark):
        index = work.keep(build_index(placed), "index")
    counted = index.select(
        F.size("n").cast("long").alias("docs"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("words")
    ).agg(F.sum("docs"), F.sum("words")).first()
    found = None
    for block in range(n_blocks if counted[0] else 0):
        own = blocks.filter(F.col("block") == block).orderBy("place").select("item_id", "text").collect()
        part = _search_block(placed, index, own, item_type, counted, best, work)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, id long, score long")
    return found


def _search_block(placed, index, own, item_type, counted, best, work) -> DataFrame:
    spark = placed.sparkSession
    with bounded_batches(spark):
        queries = make_queries(placed, [r.text for r in own], *counted)
    with bounded_batches(spark, 8):
        bounds = work.keep(_highest_bounds(index, queries, best), "bounds")
    seeds = _first(bounds, best, "row", "file", "row")
    seeds = work.keep(seeds.groupBy("file", "row").agg(F.collect_list("item").alias("items")), "seeds")
    with bounded_batches(spark):
        first = work.keep(_scored(placed, seeds, queries, best), "seed-scores")
    least: list[tuple[int, int | None]] = [(0, None)] * len(own)
    for r in _first(first, best, "id", "id").filter(F.col("rank") == best).collect():
        least[r.item] = (r.score, r.id)
    with bounded_batches(spark, 8):
        candidates = work.keep(_not_excluded(index, queries, least), "candidates")
    with bounded_batches(spark):
        scores = work.keep(_scored(placed, candidates, queries, best), "scores")
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(own)], f"item int, item_id {item_type}")
    return work.keep(
        _first(scores, best, "id", "id").join(F.broadcast(names), "item").select("item_id", "rank", "id", "score"),
        "ranked",
    )
