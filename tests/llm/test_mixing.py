"""Mixing by hash thresholds against sorting by the same hash."""

import hashlib
import re

import pytest

from codeloom.llm import mixing
from codeloom.llm.mixing import mix

SCHEMA = "doc_id long, text string, source string, _source string, size string, draw int, rank int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA).repartition(3)


def fair(words, weights, most):
    """Targets by sharing what capped sources leave, round after round."""
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(words.values()), set()
    while True:
        left = total - sum(most * words[s] for s in capped)
        share = sum(weight[s] for s in words if s not in capped)
        above = {s for s in words if s not in capped and left * weight[s] > most * words[s] * share}
        if not above:
            return {s: most * words[s] if s in capped else left * weight[s] / share for s in words}
        capped |= above


def brute(rows, weights=(5, 2, 1), most=3):
    docs = []
    for key, text, source in rows:
        body = text or ""
        draw = hashlib.md5(f"{'' if key is None else key}:{body}".encode()).hexdigest()[:15]
        docs.append((key, source, len(re.findall(r"[^\x20\x09-\x0D]+", body)), int(draw, 16)))
    words = {}
    for _, source, size, _ in docs:
        words[source] = words.get(source, 0) + size
    target = fair(words, weights, most)
    out = []
    for source, total in words.items():
        wanted = int(target[source] + 0.5)
        whole = min(most, wanted // total) if total else 0
        left = 0 if whole == most else wanted - whole * total
        for key, _, size, _ in sorted((d for d in docs if d[1] == source), key=lambda d: d[3]):
            again = left >= size or left > 0 and 2 * left >= size
            left = left - size if left >= size else 0
            out.append((str(key), source, size, total, round(target[source], 6), size * (whole + again)))
    return sorted(out, key=str)


def got(df, **options):
    return sorted(
        ((str(r.id), r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in mix(df, **options).collect()),
        key=str,
    )


ROWS = [
    (i, " ".join(["wörd"] * (1 + i * 7 % 13)) + "\n" * (i % 3), ["a", "b", "c", None, "ä", "😀"][i * i % 11 % 6])
    for i in range(200)
]


@pytest.mark.parametrize("bits", [1, 4, 12])
def test_rows_equal_sorting_by_hash(spark, monkeypatch, bits):
    # few bits a step: the boundary bucket is refined often
    monkeypatch.setattr(mixing, "BUCKET_BITS", bits)
    monkeypatch.setattr(mixing, "_STEPS", mixing.DRAW_BITS // bits)
    assert got(table(spark, ROWS)) == brute(ROWS)


def test_limits_are_shared_again_and_reached(spark):
    rows = [(i, "w " * 10, "abcd"[min(i // 2, 3)]) for i in range(60)]
    found = got(table(spark, rows), weights=(50, 9, 3), most=2)
    assert found == brute(rows, (50, 9, 3), 2)
    assert {r[5] for r in found if r[1] == "a"} == {20}


def test_most_of_a_source_being_one_row_repeated(spark):
    rows = [(7, "same words here", "a")] * 90 + [(i, "some other words", "a") for i in range(30)]
    rows += [(None, "none of them", "b")] * 90
    found = got(table(spark, rows))
    assert found == brute(rows) == got(table(spark, rows))
    for source in "ab":
        own = [r for r in found if r[1] == source]
        assert abs(sum(r[5] for r in own) - own[0][4]) <= 1.5


def test_null_texts_no_words_and_empty_tables(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t", None), (4, "one", "b")]
    assert got(table(spark, rows)) == brute(rows)
    assert got(table(spark, rows[:3])) == brute(rows[:3])
    assert got(table(spark, [])) == []


def test_a_large_budget_takes_what_a_small_one_takes(spark):
    less = {r[0]: r[5] for r in got(table(spark, ROWS), weights=(1, 2, 1))}
    more = {r[0]: r[5] for r in got(table(spark, ROWS), weights=(3, 2, 1))}
    own = [str(i) for i, _, s in ROWS if s == "a"]
    assert all(less[i] <= more[i] for i in own) and any(less[i] < more[i] for i in own)


def test_plan_has_no_python(spark):
    assert "Python" not in mix(table(spark, ROWS))._jdf.queryExecution().toString()
