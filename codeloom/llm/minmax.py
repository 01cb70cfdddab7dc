"""Near-duplicate detection by min-max hashing.

One permutation of the shingles yields two signature values, its minimum and its
maximum, so a signature of 2k values costs k hash evaluations per shingle.  The
values are cut into bands; documents that share a band are candidates.

Work is done on classes, documents with the same shingle set, of which copies need
no comparison.  Candidates are confirmed on full sets.  A band's members are first
compared with one member each, the one that shares bands with most others; only
where a band still holds several components are its members compared further, by an
exact prefix filter on their full sets.  Pairs inside one component are never listed, and
no link between components is left out.

Chance of missing a pair of similarity s: (1 - s^ROWS)^BANDS, 4e-7 at 0.85 and
5e-5 at 0.8; pairs above are missed less often still, and most are linked through
third documents.

Defined results: null and empty texts, and texts without words, have no shingles and
link with nothing; rows that repeat an id are one document, linked with all that any of
its texts links with; rows without an id are left unlinked, with no component; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.work import WorkTables, join_groups
from .common import bounded_batches, broadcast_if, map_rows, text_bytes
from .components import components
from .shingles import mix, shingle_set

PERMUTATIONS = 64
ROWS = 5
BANDS = 2 * PERMUTATIONS // ROWS
PERCENT = 80
_BLOCK = 2048

_SEEDS = np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)
_TIMES = (mix(_SEEDS * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1))[:, None]
_PLUS = mix(_SEEDS * np.uint64(0xD1B54A32D192ED03))[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """All minima, then all maxima, of the permuted shingles; in blocks, so that a
    very long text takes no more memory than a short one."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(PERMUTATIONS, dtype=np.uint64)
    for at in range(0, len(shingles), _BLOCK):
        permuted = shingles[None, at : at + _BLOCK] * _TIMES
        permuted += _PLUS
        np.minimum(low, permuted.min(axis=1), out=low)
        np.maximum(high, permuted.max(axis=1), out=high)
    return np.concatenate([low, high])


def bands(values: np.ndarray) -> np.ndarray:
    """One number per band, from its place and its values."""
    rows = values[: BANDS * ROWS].reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        total = mix(total ^ mix(rows[:, i] + np.uint64(i)))
    return total


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n_shingles, set_hash (of the whole set), bands; the last two null
    for texts without words."""

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        counts, hashes, found = [], [], []
        for text in text_bytes(batch.column(1)):
            shingles = shingle_set(text)
            counts.append(len(shingles))
            if len(shingles):
                hashes.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                found.append(bands(signature(shingles)).view(np.int64))
            else:
                hashes.append(None)
                found.append(None)
        return {"id": batch.column(0), "n_shingles": counts, "set_hash": hashes, "bands": found}

    return map_rows(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")),
        make, "id long, n_shingles long, set_hash binary, bands array<long>",
    )


def shingle_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, set_hash, shingles."""

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        sets = [shingle_set(t) for t in text_bytes(batch.column(1))]
        return {
            "id": batch.column(0),
            "set_hash": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
            "shingles": [s.view(np.int64) for s in sets],
        }

    return map_rows(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")),
        make, "id long, set_hash binary, shingles array<long>",
    )


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
    work: WorkTables | None = None,
) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component (smallest id reachable over links
    of at least ``percent`` similarity; null without an id)."""
    work = work or WorkTables(docs.sparkSession)
    with bounded_batches(docs.sparkSession):
        signed = work.keep(signatures(docs, id_col, text_col), "signatures")
    # a class is known by its smallest id; where that id has several texts, by a number
    classes = work.keep(
        signed.filter("set_hash IS NOT NULL AND id IS NOT NULL").groupBy("set_hash").agg(
            F.min("id").alias("first_id"), F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"), F.count("*").alias("size"),
        ).withColumn("rep", F.monotonically_increasing_id()),
        "classes",
    )
    rows = work.keep(signed.drop("bands"), "rows")
    work.discard(signed)
    members = _members(classes, work)
    named = work.keep(classes.select("set_hash", "rep", "first_id", "size"), "names")
    work.discard(classes)
    edges = _links(docs, named, members, percent, id_col, text_col, work)
    labels = components(_with_shared_ids(edges, rows, named, work), work)
    labelled = named.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "label", F.coalesce("label", "rep")
    )
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component"))
    total = rows.count()
    sizes = labelled.groupBy("label").agg(F.count("*").alias("classes"))
    named_by = work.keep(
        join_groups(
            labelled.select("set_hash", "size", "label"),
            work.keep(smallest.join(sizes, "label"), "components"), "label", "classes", total,
        ).select("set_hash", "size", "component"),
        "named",
    )
    linked = join_groups(
        rows.filter("set_hash IS NOT NULL AND id IS NOT NULL"), named_by, "set_hash", "size", total
    )
    alone = rows.filter("set_hash IS NULL OR id IS NULL")
    return linked.select("id", "n_shingles", "component").unionByName(
        alone.select("id", "n_shingles", F.col("id").alias("component"))
    )


def _with_shared_ids(edges, rows, named, work) -> DataFrame:
    """``edges`` and links between the classes of an id that repeats with different texts:
    its rows are one document."""
    repeated = (
        rows.filter("set_hash IS NOT NULL AND id IS NOT NULL").groupBy("id")
        .agg(F.count("*").alias("n_rows")).filter("n_rows > 1").select("id")
    )
    repeated = work.keep(
        rows.join(repeated, "id", "left_semi").filter("set_hash IS NOT NULL")
        .select("id", "set_hash").distinct(),
        "repeated-ids",
    )
    classes = repeated.join(named.select("set_hash", "rep"), "set_hash").select("id", "rep")
    least = classes.groupBy("id").agg(F.min("rep").alias("a"))
    return work.keep(
        edges.unionByName(classes.withColumnRenamed("rep", "b").join(least, "id").filter("a <> b").select("a", "b")),
        "all-links",
    )


def _members(classes: DataFrame, work: WorkTables) -> DataFrame:
    """(band, rep, n, band_size) of bands that hold at least two classes."""
    rows = classes.select("rep", "n", F.explode("bands").alias("band"))
    sizes = work.keep(
        rows.groupBy("band").agg(F.count("*").alias("band_size")).filter("band_size > 1"), "bands"
    )
    return work.keep(rows.join(sizes, "band"), "members")


def _links(docs, named, members, percent, id_col, text_col, work) -> DataFrame:
    sets = _needed_sets(docs, named, members, id_col, text_col, work)
    hub = work.keep(
        members.join(
            members.groupBy("rep").agg(F.sum("band_size").alias("shared")), "rep"
        )
        .groupBy("band")
        .agg(F.max(F.struct("shared", -F.col("rep"), "rep", "n")).alias("hub"))
        .select("band", F.col("hub.rep").alias("other"), F.col("hub.n").alias("other_n")),
        "hubs",
    )
    first = _pairs(members.join(hub, "band"), percent)
    edges = work.keep(_confirmed(first, sets, percent, work, "hub-pairs"), "hub-links")
    links = work.keep(
        edges.unionByName(_rest(members, edges, sets, percent, work)).distinct(), "links"
    )
    work.discard(sets, members, hub, edges)
    return links


def _rest(members, edges, sets, percent, work) -> DataFrame:
    """Links between components that share a band, once hubs have been compared.

    In a crowd of texts that share a template, nearly all share bands though few are
    similar enough.  So the sets of those left are compared by prefix: with shingles in
    the order of how few of them hold one, two sets reach the similarity only if their
    first n - percent * n + 1 shingles meet.  These are what sets a text apart from its
    template, so that pairs which have just the template in common are never listed.
    The filter is exact.
    """
    labels = components(edges, work).withColumnRenamed("node", "rep")
    placed = work.keep(
        members.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")),
        "placed",
    )
    # of two members the hub was one
    mixed = placed.filter("band_size > 2").groupBy("band").agg(
        F.min("label").alias("low"), F.max("label").alias("high")
    ).filter("low <> high").select("band")
    crowd = work.keep(
        placed.join(mixed, "band", "left_semi").select("rep", "n", "label").distinct(), "crowd"
    )
    work.discard(placed)
    prefixes = work.keep(_prefixes(crowd, sets, percent, work), "prefixes")
    counts = prefixes.groupBy("shingle", "label").agg(F.count("*").alias("here"))
    largest = work.keep(
        counts.groupBy("shingle")
        .agg(F.max(F.struct("here", "label")).alias("top"), F.count("*").alias("n_labels"))
        .filter("n_labels > 1")
        .select("shingle", F.col("top.label").alias("largest")),
        "largest",
    )
    open_ = work.keep(prefixes.join(largest, "shingle"), "open")
    work.discard(prefixes)
    outside = open_.filter("label <> largest").select(
        "shingle", F.col("rep").alias("other"), F.col("n").alias("other_n"),
        F.col("label").alias("other_label"), F.col("place").alias("other_place"),
    )
    # of two outsiders the larger number asks
    once = (F.col("label") == F.col("largest")) | (F.col("rep") < F.col("other"))
    # what two sets can have in common from this shingle on
    most = F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))
    total = F.col("n") + F.col("other_n")
    pairs = _pairs(
        open_.join(outside, "shingle").filter(
            (F.col("label") != F.col("other_label")) & once & (most * (100 + percent) >= total * percent)
        ),
        percent,
    )
    found = work.keep(_confirmed(pairs, sets, percent, work, "rest-pairs"), "rest-links")
    work.discard(open_)
    return found


def _prefixes(crowd, sets, percent, work) -> DataFrame:
    """(shingle, rep, n, label, place): each set's first shingles, the rarest in the crowd
    first, without those that no other set has; ``place`` counts from 0."""
    tokens = work.keep(
        sets.join(crowd.select("rep"), "rep", "left_semi").select("rep", F.explode("shingles").alias("shingle")),
        "crowd-shingles",
    )
    holders = work.keep(
        tokens.groupBy("shingle").agg(F.count("*").alias("holders")).filter("holders > 1"), "holders"
    )
    # a shingle of its own stands first, and need not be carried along
    shared = tokens.join(holders, "shingle").groupBy("rep").agg(
        F.array_sort(F.collect_list(F.struct("holders", "shingle"))).alias("shared")
    )
    length = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    own = F.col("n") - F.size("shared")
    found = work.keep(
        crowd.join(shared, "rep").filter(own < length).select(
            "rep", "n", "label", own.alias("own"),
            F.posexplode(F.slice("shared", F.lit(1), (length - own).cast("int"))).alias("at", "token"),
        ).select(F.col("token.shingle").alias("shingle"), "rep", "n", "label", (F.col("own") + F.col("at")).alias("place")),
        "first-shingles",
    )
    work.discard(tokens, holders)
    return found


def _pairs(joined: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs whose set sizes allow the similarity."""
    small, large = F.least("n", "other_n"), F.greatest("n", "other_n")
    return joined.filter(
        (F.col("rep") != F.col("other")) & (small * 100 >= large * percent)
    ).select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def _needed_sets(docs, named, members, id_col, text_col, work) -> DataFrame:
    """(rep, shingles): full shingle sets of the classes that share a band with another."""
    needed = work.keep(
        members.select("rep").distinct().join(named.select("rep", "first_id", "set_hash"), "rep")
        .select("rep", F.col("first_id").alias("id"), "set_hash"),
        "needed",
    )
    n = needed.count()
    chosen = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(
        broadcast_if(needed.select(F.col("id").alias("_id")).distinct(), n), "_id", "left_semi"
    )
    with bounded_batches(docs.sparkSession):
        return work.keep(
            shingle_sets(chosen, "_id", "_text").join(broadcast_if(needed, n), ["id", "set_hash"])
            .dropDuplicates(["rep"]).select("rep", "shingles"),
            "sets",
        )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, work: WorkTables, name: str) -> DataFrame:
    """Pairs that reach the similarity on their full sets.

    The set of the pair's less frequent end travels; a hub's set is met in place, and
    its rows are split where they are many.
    """
    pairs = work.keep(pairs, name)
    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))
    used = work.keep(ends.groupBy("rep").agg(F.count("*").alias("uses")), f"{name}-uses")
    turned = pairs.join(
        used.select(F.col("rep").alias("a"), F.col("uses").alias("a_uses")), "a"
    ).join(used.select(F.col("rep").alias("b"), F.col("uses").alias("b_uses")), "b")
    a_rare = F.col("a_uses") <= F.col("b_uses")
    turned = work.keep(
        turned.select(
            F.when(a_rare, F.col("a")).otherwise(F.col("b")).alias("rare"),
            F.when(a_rare, F.col("b")).otherwise(F.col("a")).alias("hub"),
        ),
        f"{name}-turned",
    )
    work.discard(pairs, used)
    met = turned.join(
        sets.select(F.col("rep").alias("rare"), F.col("shingles").alias("rare_set")), "rare"
    ).join(sets.select(F.col("rep").alias("hub"), F.col("shingles").alias("hub_set")), "hub")
    common = F.size(F.array_intersect("rare_set", "hub_set"))
    union = F.size("rare_set") + F.size("hub_set") - common
    return met.filter(common * 100 >= union * percent).select(
        F.least("rare", "hub").alias("a"), F.greatest("rare", "hub").alias("b")
    )


def keep_one(
    docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the documents that link to one with a smaller id; rows
    without an id stay."""
    work = WorkTables(docs.sparkSession)
    found = near_duplicates(docs, percent, id_col, text_col, work)
    gone = work.keep(
        found.filter("component < id").select(F.col("id").alias("_gone")).distinct(), "gone"
    )
    return docs.join(
        broadcast_if(gone, gone.count()), docs[id_col] == gone["_gone"], "left_anti"
    )
