"""Mixing sources to target weights by hash-threshold histograms, in DataFrame expressions only.

Sources, in code point order with null last, weigh ``weights`` in turn and share all words;
a source gives each document at most ``most`` times, and what it cannot give is shared
again by weight among the others.  A source's target is met by whole passes over it and a
part of one more: documents whose hash lies below the source's threshold.  A larger
budget only raises thresholds, so a smaller mix lies within a larger one.

Thresholds come from histograms of words by source and leading hash bits.  Only the bucket
in which the budget ends is looked at again, by its next bits, until it holds one
document; that one is taken if the source's words come nearer to the target.  Nothing is
sorted, and the last pass compares each document's hash with its source's threshold.

Defined results: the hash covers identifier and text; of rows that repeat both it does
not matter which ones are taken, and a further hash, of their place in the work table,
parts them; null text has no words; a null source is a source, the last one; a source
without words has target 0; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.work import BROADCAST_ROWS, WorkTables, dense_index, join_groups

WEIGHTS = (5, 2, 1)
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"
# A hash has DRAW_BITS bits (15 hex digits), of which each histogram takes BUCKET_BITS.
DRAW_BITS = 60
BUCKET_BITS = 12
_STEPS = DRAW_BITS // BUCKET_BITS


def sizes(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Per row: id, source, size, draw, copy_draw, and the source as a key without nulls."""
    body = F.coalesce(F.col(text), F.lit(""))
    named = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), body)
    return docs.select(
        F.col(key).alias("id"),
        F.col(source).alias("source"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(named.cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("long").alias("draw"),
        F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - DRAW_BITS).alias("copy_draw"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("_source"),
    )


def _bucket(step: int) -> Column:
    """The hash bits of one step: those of ``draw`` from the top, then those of ``copy_draw``."""
    name = "draw" if step < _STEPS else "copy_draw"
    shift = DRAW_BITS - BUCKET_BITS * (step % _STEPS + 1)
    return F.shiftright(name, shift).bitwiseAND((1 << BUCKET_BITS) - 1).cast("int")


def _histogram(rows: DataFrame, step: int) -> DataFrame:
    return rows.groupBy("_source", _bucket(step).alias("bucket")).agg(
        F.sum("size").alias("words"), F.count("*").alias("rows"),
        F.min("draw").alias("least_draw"), F.min("copy_draw").alias("least_copy"),
    )


def targets(
    histogram: DataFrame, weights: Sequence[int], most: int, work: WorkTables
) -> DataFrame:
    """Per source: words, rows, target, whole (full passes) and extra (words of one more)."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    totals = histogram.groupBy("_source").agg(
        F.sum("words").alias("words"), F.sum("rows").alias("rows")
    ).withColumn("_null", F.col("_source") == "")
    ranked = work.keep(dense_index(totals, [], ["_null", "_source"], "rank", work), "sources")
    turn = F.element_at(
        F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")
    )
    ranked = ranked.select("_source", "words", "rows", turn.alias("weight"))
    all_words = ranked.agg(F.sum("words")).first()[0] or 0

    def capped(left: int, open_weight: int) -> Column:
        wide = "decimal(38,0)"
        return F.col("weight").cast(wide) * F.lit(left).cast("decimal(18,0)") > F.col("words").cast(
            wide
        ) * F.lit(most * open_weight).cast("decimal(18,0)")

    # the level only rises, so a source once at its limit stays there
    left, open_weight = all_words, ranked.agg(F.sum("weight")).first()[0] or 0
    while True:
        at_limit = capped(left, open_weight)
        row = ranked.agg(
            F.sum(F.when(at_limit, F.col("words") * most)), F.sum(F.when(~at_limit, F.col("weight")))
        ).first()
        now = (all_words - (row[0] or 0), row[1] or 0)
        if now == (left, open_weight) or not now[1]:
            break
        left, open_weight = now
    target = F.when(capped(left, open_weight), (F.col("words") * most).cast("double")).otherwise(
        (F.lit(left) * F.col("weight")).cast("double") / F.lit(float(max(open_weight, 1)))
    )
    wanted = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("words") == 0, F.lit(0)).otherwise(
        F.least(F.lit(most), (wanted - wanted % F.col("words")) / F.col("words"))
    ).cast("long")
    return work.keep(
        ranked.withColumn("target", target).withColumn("whole", whole).withColumn(
            "extra", F.when(F.col("whole") == most, F.lit(0)).otherwise(wanted - F.col("whole") * F.col("words"))
        ),
        "targets",
    )


def _with_source(rows: DataFrame, sources: DataFrame, n: int, total: int) -> DataFrame:
    """Rows with their source's columns; rows of large sources are not shuffled."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(sources.drop("rows")), "_source")
    return join_groups(rows, sources, "_source", "rows", total).drop("rows")


def thresholds(
    rows: DataFrame, histogram: DataFrame, plan: DataFrame, n: int, total: int, work: WorkTables
) -> DataFrame:
    """Per source whose budget ends inside it: the (draw, copy_draw) of the document there, and
    whether that one is taken.  A document below is taken."""
    earlier = W.partitionBy("_source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    left = plan.filter("extra > 0").select("_source", F.col("extra").alias("left"))
    settled = []
    for step in range(2 * _STEPS):
        ends = work.keep(
            histogram.join(left, "_source")
            .withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
            .filter("before <= left AND left < before + words")
            .withColumn("left", F.col("left") - F.col("before")),
            "ends",
        )
        last = step == 2 * _STEPS - 1
        done = F.lit(last) | (F.col("rows") == 1) | (F.col("left") == 0)
        settled.append(
            ends.filter(done).select(
                "_source", "least_draw", "least_copy",
                ((F.col("rows") == 1) & (F.col("left") > 0) & (F.col("left") * 2 >= F.col("words"))).alias("last_too"),
            )
        )
        # as many rows as there are sources at most
        inside = ends.filter(~done).select("_source", F.col("bucket").alias("end"), "rows", "left")
        if last or inside.isEmpty():
            break
        rows = work.keep(
            _with_source(rows, inside.select("_source", "end", "rows"), n, total)
            .filter(_bucket(step) == F.col("end")).select("_source", "size", "draw", "copy_draw"),
            "inside",
        )
        left = inside.select("_source", "left")
        histogram = _histogram(rows, step + 1)
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    return found


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, key: str = "doc_id",
    text: str = "text", source: str = "source", work: WorkTables | None = None,
) -> DataFrame:
    """Per row of ``docs``: id, source, size, source_size, target (of its source), times
    (how often the mix takes the document) and taken (its words there)."""
    work = work or WorkTables(docs.sparkSession)
    rows = work.keep(sizes(docs, key, text, source), "sizes")
    histogram = work.keep(_histogram(rows, 0), "histogram")
    plan = targets(histogram, weights, most, work)
    counted = plan.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    ends = thresholds(rows, histogram, plan, counted[0], counted[1], work)
    plan = work.keep(plan.join(ends, "_source", "left"), "plan")
    below = (F.col("draw") < F.col("least_draw")) | (
        (F.col("draw") == F.col("least_draw"))
        & ((F.col("copy_draw") < F.col("least_copy"))
           | ((F.col("copy_draw") == F.col("least_copy")) & F.col("last_too")))
    )
    times = F.col("whole") + F.when(below, 1).otherwise(0)
    return _with_source(rows, plan, *counted).select(
        "id", "source", "size", F.col("words").alias("source_size"), "target",
        times.alias("times"), (F.col("size") * times).alias("taken"),
    )
