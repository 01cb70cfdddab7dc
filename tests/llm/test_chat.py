"""Transcript parsing: Viterbi against one plain pass, turns, empty cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.functions.work import WorkTables
from codeloom.llm import chat

PARTS = "conv long, part long, text string, known int"


def plain_viterbi(model, seen):
    scores, back = model.steps[chat.START] + model.seen[:, seen[0]], []
    for line in seen[1:]:
        ways = scores[:, None] + model.steps[: chat.STATES]
        back.append(ways.argmax(0))
        scores = ways.max(0) + model.seen[:, line]
    path = [int(scores.argmax())]
    for choice in reversed(back):
        path.append(int(choice[path[-1]]))
    return path[::-1]


def parts(spark, rows):
    return spark.createDataFrame([(c, p, t, None) for c, p, t in rows], PARTS)


def test_segments_give_the_path_of_one_pass(spark, monkeypatch):
    """Three levels of segments, against a single pass over each transcript."""
    monkeypatch.setattr(chat, "SEGMENT", 4)
    rng = np.random.default_rng(1)
    texts = ["User: hi", "Assistant: well", "plain line", "", "what is it?", "System: rules", "long " * 30]
    rows = [(c, i, texts[rng.integers(len(texts))]) for c, n in ((1, 90), (2, 3), (3, 17)) for i in range(n)]
    work = WorkTables(spark)
    lines = chat.lines_of(parts(spark, rows), work)
    model = chat.fit(lines)
    got = chat.states(lines, model, work).join(lines.select("conv", "pos", "seen"), ["conv", "pos"]).collect()
    for conv in ("1", "2", "3"):
        own = sorted((r.pos, r.seen, r.state) for r in got if r.conv == conv)
        path, best = [s for _, _, s in own], plain_viterbi(model, [x for _, x, _ in own])

        def value(states, seen=[x for _, x, _ in own]):  # noqa: B006
            before = [chat.START, *states[:-1]]
            return sum(model.steps[a, b] + model.seen[b, o] for a, b, o in zip(before, states, seen))

        assert value(path) == pytest.approx(value(best))


def test_lines_are_seen_as_in_one_pass(spark, monkeypatch):
    """Observations, counts and turns do not depend on where segments are cut."""
    rng = np.random.default_rng(2)
    texts = ["User: hi", "", "plain line", "what?", "one\ntwo\n", "long " * 30]
    rows = [(c, i, texts[rng.integers(len(texts))], int(rng.integers(3)) if i % 5 else None)
            for c, n in ((1, 60), (2, 4), (None, 30)) for i in range(n)]
    got = []
    for segment in (4, 1024):
        monkeypatch.setattr(chat, "SEGMENT", segment)
        work, given = WorkTables(spark), spark.createDataFrame(rows, PARTS)
        lines = chat.lines_of(given, work)
        model = chat.fit(lines)
        turns = sorted(tuple(r) for r in chat.parse(given).collect())
        found = sorted(lines.select("conv", "pos", "line", "seen", "known", "before").collect(), key=lambda r: r[:2])
        got.append((found, model.steps.tolist(), model.seen.tolist(), turns))
    assert got[0] == got[1]
    before = {}
    for row in got[0][0]:
        line, known = before.get(row.conv, ("", chat.START))
        assert row.seen % 2 == (line.strip() == "") and row.before == known
        before[row.conv] = row.line, row.known


def test_turns_of_a_plain_transcript(spark):
    text = "System: be kind\nUser: hello\nhow are you?\n\nAssistant: fine\n- one\n- two\nUser: bye"
    got = chat.parse(parts(spark, [(7, 0, text)])).orderBy("turn").collect()
    assert [(r.turn, r.role, r.text) for r in got] == [
        (0, "system", "be kind"), (1, "user", "hello\nhow are you?"), (2, "assistant", "fine\n- one\n- two"),
        (3, "user", "bye"),
    ]
    assert got[0].rendered == "<|system|>\nbe kind\n<|end|>\n"


@pytest.mark.parametrize("style", ["{}: x", "**{}:** x", "### {}: x", "[{}]: x", "{} >> x", "<|{}|> x"])
def test_marker_styles(spark, style):
    frame = spark.createDataFrame([(style.format(n),) for n in ("Human", "assistant", "SYSTEM")], "t string")
    found = frame.select(chat.marker(F.col("t")), chat.without_marker(F.col("t"))).collect()
    assert [tuple(r) for r in found] == [(2, "x"), (3, "x"), (1, "x")]


def test_known_roles_teach_unmarked_turns(spark):
    """Answers are long and questions end in a question mark; markers are rare."""
    rows = []
    for c in range(40):
        for i in range(6):
            text = "why is that so?" if i % 2 == 0 else "because " * 20
            rows.append((c, i, text, i % 2 + 1 if c % 2 else None))
    got = chat.parse(spark.createDataFrame(rows, PARTS)).filter("conv = '10'").orderBy("turn").collect()
    assert [r.role for r in got] == ["user", "assistant"] * 3


def test_nulls_repeats_and_empty_tables(spark):
    assert chat.parse(parts(spark, [])).collect() == []
    rows = [(1, 0, None), (2, 0, ""), (3, 0, "User: a"), (3, 0, "User: a"), (None, 0, "User: b"), (None, None, "c")]
    got = chat.parse(parts(spark, rows)).collect()
    assert sum(r.n_lines for r in got) == len(rows)
    assert {r.conv for r in got} == {"", "1", "2", "3"}
