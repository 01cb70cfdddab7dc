"""Quality classifier: ridge regression on random Fourier features.

Statistics of the whole text are mapped through random cosines, whose inner products
approximate a Gaussian kernel.  Each partition of the training rows sums its part of
the normal equations for both of two folds; the ridge solution of each fold scores
the other one, and isotonic regression of these scores gives the calibration of the
model that is fitted on both.  Scoring is one pass over the texts.

At most TRAIN_ROWS labelled rows, chosen by a hash of their id, are learnt from.

Defined results: null text is the empty text, all of whose statistics are 0, and is
scored like any other; with no labelled row every score is 0.5; rows that repeat an
id are scored each for itself; a row without an id is not held out and teaches nothing; labels that repeat an id or are null are left out or
counted as they stand; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.work import WorkTables
from .common import broadcast_if, give_back, learn_from, map_rows, small_batches, text_bytes

FEATURES = 256
KERNEL_WIDTH = 3.0
RIDGE = 1.0
TRAIN_ROWS = 100_000
ROWS_PER_PARTITION = 20_000
BINS = 1024
_FARTHEST = 5.0

_DELETE = {
    "letters": bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)),
    "upper": bytes(range(0x41, 0x5B)),
    "digits": b"0123456789",
    "ends": b".,;:?",
    "bars": b"|/\\<>{}[]=_~^",
    "signs": b"#$%&*@+",
    "calls": b"!",
    "space": b" \t\n\r\x0b\x0c",
}


def statistics(text: bytes) -> list[float]:
    """Numbers that do not depend on a language: shares of kinds of characters, word
    lengths, and how much of the text is repetition."""
    words = text.split()
    n, size = len(words), len(text)
    if n == 0:
        return [0.0] * STATISTICS
    shares = [(size - len(text.translate(None, c))) / size for c in _DELETE.values()]
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1) if n > 1 else 1.0
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    lines = [line for line in text.split(b"\n") if line]
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    letters = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / size
    letters = letters[letters > 0]
    return [
        *shares,
        math.log1p(n),
        float(lengths.mean()),
        math.log1p(float(lengths.max())),
        float(lengths.std()),
        math.log1p(len(counts)) / math.log1p(n),
        max(counts.values()) / n,
        pairs,
        same,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        float(-(letters * np.log2(letters)).sum()),
    ]


STATISTICS = len(_DELETE) + 11


@dataclass
class Model:
    """Everything a task needs to score statistics; its size is fixed."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng(7)
        slopes = draw.normal(0, 1 / KERNEL_WIDTH, (STATISTICS, FEATURES))
        phases = draw.uniform(0, 2 * math.pi, FEATURES)
        scaled = np.clip((stats - self.mean) / self.spread, -_FARTHEST, _FARTHEST)
        waves = np.cos(scaled @ slopes + phases) * math.sqrt(2 / FEATURES)
        return np.hstack([waves * 8, np.ones((len(stats), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        raw = self.features(stats) @ self.weights
        level = np.interp(raw, *self.knots)
        # a trace of the raw score orders documents of one calibration step
        return np.clip(0.998 * level + 0.002 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def isotonic(values: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and levels of the rising steps.

    ``values`` rise; ``labels`` are sums over ``rows`` rows each.
    """
    pools: list[list[float]] = []
    for value, label, n in zip(values, labels, rows):
        pools.append([value * n, label, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    sums = np.array(pools)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


def _training(docs, labels, id_col, text_col, work, most) -> tuple[DataFrame, int]:
    """(stats, y, fold) of the labelled rows that are learnt from."""
    learn = labels.filter(
        learn_from(F.col("doc_id")) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()
    ).select(
        F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_y"),
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0).cast("int").alias("_fold"),
    )
    n = learn.count()
    if n > most:
        learn = learn.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
        n = learn.count()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        broadcast_if(learn, n), "_id"
    )

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        return {
            "stats": [statistics(t) for t in text_bytes(batch.column(0))],
            "y": batch.column(1), "fold": batch.column(2),
        }

    stats = map_rows(
        rows.select("_text", "_y", "_fold"), make, "stats array<double>, y double, fold int"
    )
    return work.keep(stats, "training"), n


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten()).reshape(len(column), STATISTICS)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    most: int = TRAIN_ROWS, work: WorkTables | None = None,
) -> Model:
    small_batches(docs.sparkSession)
    work = work or WorkTables(docs.sparkSession)
    training, n = _training(docs, labels, id_col, text_col, work, most)
    moments = training.select(F.posexplode("stats").alias("at", "value")).groupBy("at").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread")
    ).orderBy("at").collect()
    if not moments:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS))
    model = Model(
        np.array([m["mean"] for m in moments]),
        np.array([m["spread"] if m["spread"] > 1e-9 else 1.0 for m in moments]),
    )
    width = FEATURES + 1

    def equations(batches):
        gram, moment = np.zeros((2, width, width)), np.zeros((2, width))
        for batch in batches:
            x, y = model.features(_matrix(batch.column(0))), np.array(batch.column(1))
            fold = np.array(batch.column(2))
            for f in (0, 1):
                gram[f] += x[fold == f].T @ x[fold == f]
                moment[f] += x[fold == f].T @ y[fold == f]
        yield pa.RecordBatch.from_pydict(
            {"gram": pa.array([gram.tobytes()], pa.binary()), "moment": pa.array([moment.tobytes()], pa.binary())}
        )

    # the number of partitions, and so of sums, is bounded by TRAIN_ROWS
    parts = math.ceil(max(n, 1) / ROWS_PER_PARTITION)
    gram, moment = np.zeros((2, width, width)), np.zeros((2, width))
    for row in training.repartition(parts).mapInArrow(equations, "gram binary, moment binary").collect():
        gram += np.frombuffer(row["gram"]).reshape(gram.shape)
        moment += np.frombuffer(row["moment"]).reshape(moment.shape)
    penalty = RIDGE * np.eye(width)
    penalty[-1, -1] = 1e-6
    by_other = [np.linalg.solve(gram[1 - f] + penalty, moment[1 - f]) for f in (0, 1)]
    model.weights = np.linalg.solve(gram.sum(0) + penalty, moment.sum(0))

    def cross_scores(batch: pa.RecordBatch) -> dict[str, list]:
        x, fold = model.features(_matrix(batch.column(0))), np.array(batch.column(2))
        raw = np.where(fold == 0, x @ by_other[0], x @ by_other[1])
        bins = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(int)
        return {"bin": bins, "raw": raw, "y": batch.column(1)}

    steps = map_rows(training, cross_scores, "bin int, raw double, y double").groupBy("bin").agg(
        F.avg("raw").alias("raw"), F.sum("y").alias("y"), F.count("*").alias("n")
    ).orderBy("raw").collect()
    raw, y, rows = (np.array([s[k] for s in steps], dtype=float) for k in ("raw", "y", "n"))
    model.knots = isotonic(raw, y, rows)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        stats = np.array([statistics(t) for t in text_bytes(batch.column(1))])
        return {"id": batch.column(0), "score": shared.value.score(stats)}

    return map_rows(
        docs.select(F.col(id_col).cast("long"), F.col(text_col)), make, "id long, score double"
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, in one pass without a join."""
    model = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def passing(batches):
        for batch in batches:
            if batch.num_rows:
                stats = np.array([statistics(t) for t in text_bytes(batch.column(at))])
                yield batch.filter(pa.array(shared.value.score(stats) >= least))
        give_back()

    return docs.mapInArrow(passing, docs.schema)
