"""Benchmark decontamination with a positional inverted index.

1. Document frequencies of the benchmark's words are counted over all documents.
2. Per benchmark window the two rarest places become anchors; the index stores, per
   document, the positions of anchor words.
3. Posting lists are shifted by the anchors' places in their item; where two anchors
   of an item agree on where it would start, the document is read again and every
   word compared there.  Where they agree within some words, it is a proximity match if
   all words of a window stand there in any order.  Exact matches are proximity matches.
4. A term that stands very often both in a document and in an item is not shifted, which
   would list every pair of places; there the document is searched for the item's windows
   in one pass, and exact matches alone count as near.

The benchmark is worked in blocks of bounded size, each met by all documents; what
the tasks get of it (vocabulary, anchors, item words) is one block's.

Words are runs of letters, digits and non-ASCII characters, lower-cased in A-Z.

Defined results: null text has no words and is neither hit nor hits; an item shorter
than a window is one window; repeated items count once per item_id, and an item
without an id can be hit but not be named; rows that repeat a doc_id are searched
each for itself; an empty benchmark hits nothing; an empty table gives no rows; other
columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.work import WorkTables
from .common import (
    broadcast_if, filed, item_blocks, map_rows, placed_rows, rows_except, small_batches, text_bytes,
)

WINDOW = 10
ANCHORS = 2
SLOP = 3
# Bytes of benchmark text, give or take some items, that the tasks get at a time.
BLOCK_BYTES = 4 << 20
BLOCK_ITEMS = 16
# Shifted posting lists are listed up to so many times the lists' own length.
DENSE = 4

_AS_SPACE = bytes(
    c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)
).lower()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_AS_SPACE).split()


class Block:
    """Items of one benchmark block: words, window lengths and, once document
    frequencies are known, anchors."""

    def __init__(self, rows: list):
        self.ids = [None if r["item_id"] is None else str(r["item_id"]) for r in rows]
        self.words = [words_of((r["text"] or "").encode()) for r in rows]
        self.terms = sorted({w for words in self.words for w in words})
        self.number = {w: i for i, w in enumerate(self.terms)}

    def anchors(self, frequency: dict[int, int]) -> Iterator[tuple[int, int, int, int]]:
        """(term, item, place, needed): the rarest places of each window."""
        for item, words in enumerate(self.words):
            width = min(WINDOW, len(words))
            rank = [(frequency.get(self.number[w], 0), i) for i, w in enumerate(words)]
            chosen = {
                place
                for at in range(len(words) - width + 1 if words else 0)
                for _, place in sorted(rank[at : at + width])[:ANCHORS]
            }
            for place in sorted(chosen):
                yield self.number[words[place]], item, place, min(ANCHORS, width)

    def occurrence(self, tokens: list[bytes], item: int, start: int) -> list[int]:
        """Places of the document inside windows of the item that lies at ``start``."""
        words, hits, run = self.words[item], [], 0
        width = min(WINDOW, len(words))
        for i in range(len(words) + 1):
            at = start + i
            if i < len(words) and 0 <= at < len(tokens) and tokens[at] == words[i]:
                run += 1
                continue
            if run >= width:
                hits.extend(range(at - run, at))
            run = 0
        return hits

    def everywhere(self, tokens: list[bytes], item: int) -> list[int]:
        """Places of the document inside any occurrence of a window of the item."""
        words, hits = self.words[item], set()
        width = min(WINDOW, len(words))
        windows = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        for at in range(len(tokens) - width + 1):
            if tuple(tokens[at : at + width]) in windows:
                hits.update(range(at, at + width))
        return sorted(hits)

    def stands_near(self, tokens: list[bytes], item: int, start: int, place: int, slop: int) -> bool:
        """Whether all words of a window over ``place`` stand, in any order, at most ``slop``
        words before or behind where an item that lies at ``start`` has it."""
        words = self.words[item]
        width = min(WINDOW, len(words))
        for at in range(max(0, place - width + 1), min(place, len(words) - width) + 1):
            span = tokens[max(0, start + at - slop) : max(0, start + at + width + slop)]
            if not Counter(words[at : at + width]) - Counter(span):
                return True
        return False


def _blocks(bench: DataFrame, work: WorkTables) -> Iterator[Block]:
    blocks, n = item_blocks(bench, "item_id", "text", work, BLOCK_BYTES, BLOCK_ITEMS)
    for i in range(max(1, n)):
        yield Block(blocks.filter(F.col("block") == i).select("item_id", "text").collect())


def _frequencies(rows: DataFrame, block: Block) -> dict[int, int]:
    """Number of documents that hold each of the block's words."""
    number = rows.sparkSession.sparkContext.broadcast(block.number)

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        known, seen = number.value, Counter()
        for text in text_bytes(batch.column(0)):
            seen.update(known.keys() & set(words_of(text)))
        return {"term": [known[w] for w in seen], "docs": list(seen.values())}

    counts = map_rows(rows.select("_text"), make, "term int, docs long")
    return dict(counts.groupBy("term").agg(F.sum("docs").alias("docs")).collect())


def positional_index(rows: DataFrame, block: Block, anchors: list) -> DataFrame:
    """Per document: its place, n_words, and the positions of anchor words."""
    chosen = rows.sparkSession.sparkContext.broadcast(
        {block.terms[term]: term for term, *_ in anchors}
    )

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        known, counts, postings = chosen.value, [], []
        for text in text_bytes(batch.column(3)):
            words = words_of(text)
            counts.append(len(words))
            lists: dict[int, list[int]] = {}
            if not known.keys().isdisjoint(words):
                for at, word in enumerate(words):
                    if word in known:
                        lists.setdefault(known[word], []).append(at)
            postings.append([{"term": t, "at": p} for t, p in lists.items()])
        return {
            "_file": batch.column(0), "_row": batch.column(1), "_id": batch.column(2),
            "n_words": counts, "postings": postings,
        }

    return map_rows(
        rows, make,
        "_file string, _row long, _id long, n_words long, "
        "postings array<struct<term: int, at: array<int>>>",
    )


def alignments(index: DataFrame, anchors: list) -> tuple[DataFrame, DataFrame]:
    """Posting lists shifted to where the item would start in the document, and the
    (_file, _row, item) for which they are not: where a term stands so often in both that
    its shifted lists would be much longer than the lists themselves."""
    spark = index.sparkSession
    places = spark.createDataFrame(anchors, "term int, item int, place int, needed int")
    by_item = places.groupBy("term", "item").agg(
        F.collect_list("place").alias("places"), F.first("needed").alias("needed")
    )
    met = (
        index.select("_file", "_row", F.explode("postings").alias("p"))
        .select("_file", "_row", "p.term", "p.at")
        .join(broadcast_if(by_item, len(anchors)), "term")
    )
    here, there = F.size("at"), F.size("places")
    often = here * there > DENSE * (here + there)
    listed = met.filter(~often).select("_file", "_row", "item", "needed", "places", F.explode("at").alias("at"))
    return listed.select(
        "_file", "_row", "item", "needed", "at", F.explode("places").alias("place")
    ).select("_file", "_row", "item", "place", "needed", (F.col("at") - F.col("place")).alias("start")), met.filter(
        often
    ).select("_file", "_row", "item").distinct()


def near_starts(aligned: DataFrame, slop: int = SLOP) -> DataFrame:
    """(_file, _row, item, start, place) where two different anchors are at most ``slop``
    words off the distance that they have in the item."""
    order = W.partitionBy("_file", "_row", "item").orderBy("start", "place")
    return (
        aligned.select(
            "_file", "_row", "item", "start", "place", "needed",
            F.lag("start").over(order).alias("before"),
            F.lag("place").over(order).alias("other"),
        )
        .filter((F.col("needed") == 1) | ((F.col("start") - F.col("before") <= slop) & (F.col("place") != F.col("other"))))
        .select("_file", "_row", "item", "start", "place")
    )


def _verified(
    rows: DataFrame, starts: DataFrame, near: DataFrame, dense: DataFrame, block: Block, slop: int
) -> DataFrame:
    """Per candidate document: its place, the hit positions, the ids of items found, and how
    many items are near."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    none = F.lit(None).cast("int")
    found = (
        starts.select("_file", "_row", F.struct("item", "start", none.alias("place")).alias("c"))
        .unionByName(near.select("_file", "_row", F.struct("item", "start", "place").alias("c")))
        .unionByName(dense.select("_file", "_row", F.struct("item", none.alias("start"), none.alias("place")).alias("c")))
    )
    per_row = found.groupBy("_file", "_row").agg(F.collect_list("c").alias("candidates"))
    n = starts.count() + near.count() + dense.count()
    joined = rows.join(broadcast_if(per_row, n), ["_file", "_row"]).select(
        "_file", "_row", "_text", "candidates"
    )

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        block, all_hits, all_items, all_near = shared.value, [], [], []
        for text, candidates in zip(text_bytes(batch.column(2)), batch.column(3).to_pylist()):
            words, hits, items, near = words_of(text), set(), set(), set()
            for c in candidates:
                item, start, place = c["item"], c["start"], c["place"]
                if place is not None:
                    if item not in near and block.stands_near(words, item, start, place, slop):
                        near.add(item)
                    continue
                places = block.everywhere(words, item) if start is None else block.occurrence(words, item, start)
                if places:
                    hits.update(places)
                    items.add(item)
            all_hits.append(sorted(hits))
            all_items.append(sorted({block.ids[i] for i in items} - {None}))
            all_near.append(len(near | items))
        return {
            "_file": batch.column(0), "_row": batch.column(1), "hits": all_hits, "items": all_items,
            "n_near": all_near,
        }

    return map_rows(
        joined, make, "_file string, _row long, hits array<int>, items array<string>, n_near long"
    )


def contamination(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    slop: int = SLOP, work: WorkTables | None = None,
) -> DataFrame:
    """Per row of ``docs``: id, file, row (its place), n_words, hits (positions inside
    windows), items (ids, sorted as strings), n_near (items with a proximity match)."""
    spark = docs.sparkSession
    small_batches(spark)
    work = work or WorkTables(spark)
    rows = placed_rows(
        filed(docs, work), _id=F.col(id_col).cast("long"), _text=F.col(text_col)
    ).select(F.col("file").alias("_file"), F.col("row").alias("_row"), "_id", "_text")
    exact, index = None, None
    for i, block in enumerate(_blocks(bench, work)):
        anchors = list(block.anchors(_frequencies(rows, block)))
        stored = work.keep(positional_index(rows, block, anchors), f"index-{i}")
        index = index or stored
        listed, dense = alignments(stored, anchors)
        aligned, dense = work.keep(listed, f"alignments-{i}"), work.keep(dense, f"dense-{i}")
        starts = work.keep(
            aligned.groupBy("_file", "_row", "item", "start")
            .agg(F.count("*").alias("n"), F.max("needed").alias("needed"))
            .filter("n >= needed").select("_file", "_row", "item", "start"),
            f"starts-{i}",
        )
        near = work.keep(near_starts(aligned, slop), f"near-{i}")
        found = work.keep(_verified(rows, starts, near, dense, block, slop), f"found-{i}")
        exact = found if exact is None else exact.unionByName(found)
    hits = exact.groupBy("_file", "_row").agg(
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.sum("n_near").alias("n_near"),
    )
    none = F.array()
    return (
        index.drop("postings")
        .join(hits, ["_file", "_row"], "left")
        .select(
            F.col("_id").alias("id"), F.col("_file").alias("file"), F.col("_row").alias("row"),
            "n_words",
            F.coalesce("hits", none.cast("array<int>")).alias("hits"),
            F.coalesce("items", none.cast("array<string>")).alias("items"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        )
    )


def drop_contaminated(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` without any hit, with their own columns."""
    work = WorkTables(docs.sparkSession)
    docs = filed(docs, work)
    found = contamination(docs, bench, id_col, text_col, work=work).filter(F.size("hits") > 0)
    return rows_except(docs, work.keep(found.select("file", "row"), "gone"))
