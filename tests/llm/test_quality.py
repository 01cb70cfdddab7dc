"""Quality classifier: held-out accuracy, calibration, empty cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import quality
from codeloom.llm.common import learn_from

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9)))
    rows, labels = {}, []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 200))]
        good = i % 4 != 0
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 8 else words[:5] * 30
        rows[i] = " ".join(words)
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_rows_are_told_apart(spark, make_docs):
    rows, labels = corpus()
    docs = make_docs([*rows.items(), (None, "no id"), (3, rows[3]), (7_000, None), (7_001, "")])
    model = quality.fit(docs, spark.createDataFrame(labels, LABELS))
    got = quality.score(docs, model).withColumn("held", ~learn_from(F.col("id"))).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    good = {i: q for i, q, _ in labels}
    held = [(r.score >= 0.5) == good[r.id] for r in got if r.held and r.id in good]
    assert len(held) > 100 and np.mean(held) > 0.97
    kept = quality.keep_good(docs.withColumn("score", F.lit(1)), spark.createDataFrame(labels, LABELS))
    assert kept.columns == [*docs.columns, "score"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted(
        r.id for r in got if r.id and r.score >= 0.5
    )


def test_labels_of_held_out_rows_are_not_looked_at(spark, make_docs):
    rows, labels = corpus(90)
    docs = make_docs(rows)
    frame = spark.createDataFrame(labels, LABELS)
    turned = frame.withColumn(
        "quality", F.when(learn_from(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality"))
    )
    scores = [
        {r.id: r.score for r in quality.score(docs, quality.fit(docs, f)).collect()} for f in (frame, turned)
    ]
    assert scores[0] == pytest.approx(scores[1], abs=1e-6)


def test_without_labels_and_without_documents(spark, make_docs):
    docs, none = make_docs({1: "a b", 2: None}), spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    one_sided = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 0), (5, None, 0)], LABELS)
    assert all(0 <= r.score <= 1 for r in quality.score(docs, quality.fit(docs, one_sided)).collect())
    empty = make_docs([])
    assert quality.score(empty, quality.fit(empty, none)).collect() == []


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    model = quality.Model(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    x = rng.normal(size=(40, quality.STATISTICS)) * 0.7
    z = model.features(x)[:, :-1] / 8
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    exact = np.exp(-far / (2 * quality.KERNEL_WIDTH**2))
    assert np.abs(z @ z.T - exact).mean() < 0.06


def test_isotonic_levels_rise_and_keep_the_mean():
    labels, rows = np.array([1.0, 0, 3, 2, 9]), np.array([4.0, 4, 4, 4, 10])
    centres, levels = quality.isotonic(np.arange(5.0), labels, rows)
    assert levels.tolist() == [0.125, 0.625, 0.9] and all(np.diff(centres) > 0)


def test_statistics_of_long_and_odd_texts_are_finite():
    for text in (b"", b" \n", b"x", b"word " * 300_000, bytes(range(256)), "é 中 😀".encode()):
        assert len(quality.statistics(text)) == quality.STATISTICS
        assert np.isfinite(quality.statistics(text)).all()


def test_scores_equal_a_direct_fit(spark, make_docs):
    """The same normal equations from one matrix, without partitions or sums of them."""
    rows, labels = corpus(240)
    docs = make_docs(rows)
    model = quality.fit(docs, spark.createDataFrame(labels, LABELS))
    got = {r.id: r.score for r in quality.score(docs, model).collect()}

    part = {i: zlib.crc32(str(i).encode()) % 3 for i, _, _ in labels}
    learn = [(i, q) for i, q, _ in labels if part[i] != 1]
    stats = np.array([quality.statistics(rows[i].encode()) for i, _ in learn])
    y, fold = np.array([q for _, q in learn], dtype=float), np.array([part[i] == 0 for i, _ in learn])
    spread = stats.std(axis=0)
    own = quality.Model(stats.mean(axis=0), np.where(spread > 1e-9, spread, 1.0))
    x = own.features(stats)
    penalty = np.diag([quality.RIDGE] * quality.FEATURES + [1e-6])

    def solved(chosen):
        return np.linalg.solve(x[chosen].T @ x[chosen] + penalty, x[chosen].T @ y[chosen])

    own.weights = solved(np.ones(len(y), dtype=bool))
    raw = np.where(fold, x @ solved(~fold), x @ solved(fold))
    bins = np.clip(np.floor((raw + 0.5) / 2 * quality.BINS), 0, quality.BINS - 1)
    steps = sorted((raw[bins == b].mean(), y[bins == b].sum(), (bins == b).sum()) for b in np.unique(bins))
    centres, sums, sizes = (np.array(c, dtype=float) for c in zip(*steps))
    # the level of a step: the largest over all starts of the smallest mean over all ends
    levels = [
        max(min(sums[a : b + 1].sum() / sizes[a : b + 1].sum() for b in range(k, len(sums))) for a in range(k + 1))
        for k in range(len(sums))
    ]
    pools = np.unique(np.round(levels, 12))
    inside = [np.isclose(levels, p, atol=1e-9) for p in pools]
    own.knots = (
        np.array([(centres[i] * sizes[i]).sum() / sizes[i].sum() for i in inside]),
        np.array([sums[i].sum() / sizes[i].sum() for i in inside]),
    )
    expected = own.score(np.array([quality.statistics(rows[i].encode()) for i in rows]))
    assert np.allclose([got[i] for i in rows], expected, atol=1e-6)
