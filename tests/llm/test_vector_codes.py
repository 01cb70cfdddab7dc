"""Product codes against plain loops over every entry."""

import math
import random

import numpy as np
import pytest

from codeloom.llm import vector_codes
from codeloom.llm.vector_codes import Orchard, encode, fit, with_label_errors

SCHEMA = "vec_id long, embedding array<double>, label int, code string, part int, _label string"


def table(spark, rows):
    full = [(*(list(r) + [None] * (3 - len(r))), "other", 7, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def brute(rows, parts, entries, rounds):
    """(id, label, code, error) of every kept row, and the codebooks; vectors are of one length."""
    kept = sorted(
        ((i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows
         if v and all(x is not None and math.isfinite(x) for x in v)),
        key=lambda r: (r[0] is None, r[0] or 0, r[1]),
    )
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for e, members in own.items():
                books[p][e] = [sum(x) // len(members) for x in zip(*members)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    return books, sorted(
        (str(k[0]), "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for k, f in zip(kept, found)
    )


def got(spark, rows, **options):
    df = table(spark, rows)
    books = fit(df, **options)
    coded = with_label_errors(encode(df, books)).collect()
    return books, sorted((str(r.id), r.code, r.error) for r in coded), coded


@pytest.mark.parametrize("seed", range(3))
def test_rows_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    # few different values, so that distances tie and texts repeat
    grain = [0.25, 1 / 4096, 1.0][seed]
    rows = [(i, [rng.randint(-3, 3) * grain for _ in range(8)], rng.choice([None, 1, 2])) for i in range(60)]
    rows += rows[:5] + [(None, rows[0][1], 1), (99, None, 1), (98, [float("nan")] * 8, 1),
                        (97, [1.0, None] * 4, 1), (96, [float("inf")] + [0.0] * 7, 1), (95, [], 1)]
    books, found, coded = got(spark, rows, parts=4, entries=6, rounds=3)
    expected_books, expected = brute(rows, 4, 6, 3)
    assert books.entries == expected_books and found == expected
    totals = {}
    for r in coded:
        totals[r.label] = totals.get(r.label, 0) + r.error
    assert all(r.label_error == totals[r.label] for r in coded) and None in totals


def test_orchard_takes_the_lower_of_equal_entries():
    rng = np.random.default_rng(1)
    for width in (1, 2):
        book = rng.integers(-4, 5, (12, width))
        book[7] = book[3]
        rows = rng.integers(-6, 7, (200, width))
        entry, best = Orchard(book.tolist()).nearest(rows)
        apart = ((rows[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (entry == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()


def test_sums_and_distances_are_exact_beyond_64_bits(spark):
    rows = [(i, [1e18 * (i + 1), -3.5e25], None) for i in range(5)]
    books, found, _ = got(spark, rows, parts=2, entries=2, rounds=2)
    expected_books, expected = brute(rows, 2, 2, 2)
    assert books.entries == expected_books
    assert [f[:2] for f in found] == [e[:2] for e in expected]
    assert all(a[2] == (b[2] if b[2] < 1 << 63 else None) for a, b in zip(found, expected))


def test_few_vectors_other_lengths_and_empty_tables(spark):
    books, found, _ = got(spark, [(1, [0.5, 0.25], 3), (2, [1.0], 3), (3, [1.0] * 4, 3)], parts=2)
    assert books.entries == [[[2048]], [[1024]]] and found == [("1", "0000", 0)]
    assert fit(table(spark, [])) is None
    assert got(spark, [])[1] == []


def test_a_batch_of_the_session_stays_as_set(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "5000")
    try:
        got(spark, [(1, [0.5] * 8, 3)])
        assert spark.conf.get(name) == "5000" and vector_codes.BATCH_ROWS < 5000
    finally:
        spark.conf.set(name, before)
