"""Chat formatting: speaker roles of transcript lines by a hidden Markov model.

A line's state is a role and whether a turn begins there.  What is seen of a line is
the kind of speaker marker it opens with and its shape (blank, question, short, long,
after a blank line).  Viterbi's best path gives the roles, from which turns are
rendered in one canonical form.

A transcript may be of any length: it is cut into segments of SEGMENT lines, each of
which is summed up by a small matrix, the best score from every state before it to
every state at its end.  Matrices are multiplied up in groups of SEGMENT, the best
states at the ends are handed down again, and each segment then finds its own lines'
states.  The path is the same as of one pass over the whole transcript, and no task
holds more than one segment or one group of matrices.

Model counts come from transcripts whose roles are known; every cell starts from a
small prior, so the model is defined without any.

Defined results: null and empty texts are one blank line; rows that repeat a place in
the transcript stand in any order next to each other; rows without a transcript id
form one transcript; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.work import WorkTables, dense_index
from .common import arrow_schema

SEGMENT = 1024
ROLES = ("system", "user", "assistant")
# state = 2 * role + (0 where a turn begins, 1 inside); the last index is before line 1
STATES, START = 2 * len(ROLES), 2 * len(ROLES)
NEVER = -1e9

# fixed values: what transcripts call the speakers
SPEAKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "question", "customer", "q", "me"),
    "assistant": ("assistant", "ai", "answer", "bot", "agent", "gpt", "model", "a"),
}
_MARK = r"^\s*(?:[#>*\-\[(<|]|\*\*)*\s*(?i:{names})\s*(?:[\])|>*]|\*\*)*\s*(?::|>>|\|>|\]|-)\s*(?:\*\*)?\s*"
SHORT_LINE = 60
MARKERS = 1 + len(ROLES)
SHAPES = 8


def _pattern(role: str) -> str:
    return _MARK.format(names="|".join(SPEAKERS[role]))


def marker(line: Column) -> Column:
    """0 without a speaker marker, else 1 + role."""
    found = F.lit(0)
    for number, role in reversed(list(enumerate(ROLES))):
        found = F.when(F.regexp_like(line, F.lit(_pattern(role))), number + 1).otherwise(found)
    return found


def blank(line: Column) -> Column:
    return F.trim(line) == ""


def shape(line: Column, after_blank: Column) -> Column:
    """Kind of line (blank, question, short, long), and whether a blank line is before it."""
    kind = (
        F.when(blank(line), 0).when(F.rtrim(line).endswith("?"), 1)
        .when(F.char_length(line) < SHORT_LINE, 2).otherwise(3)
    )
    return kind * 2 + F.when(after_blank, 1).otherwise(0)


def without_marker(line: Column) -> Column:
    names = "|".join(n for role in ROLES for n in SPEAKERS[role])
    return F.regexp_replace(line, _MARK.format(names=names), "")


def lines_of(transcripts: DataFrame, work: WorkTables) -> DataFrame:
    """(conv, pos, seg, line, seen, known, before) of transcript parts (conv, part, text,
    known); known is the state where the role of the part is given, else null, and before
    that of the line before."""
    conv = F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("conv")
    lines = transcripts.select(
        conv, "part", "known", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n", -1)).alias("at", "line"),
    )
    placed = dense_index(lines, ["conv"], ["part", "at"], "pos", work)
    # what is known of a segment's last line stands in the next segment too, in front
    own = F.floor(F.col("pos") / SEGMENT)
    last = F.col("pos") % SEGMENT == SEGMENT - 1
    state = (F.col("known") * 2 + F.when(F.col("at") == 0, 0).otherwise(1)).cast("int")
    placed = placed.select(
        "conv", "pos", "line", blank(F.col("line")).alias("blank"), state.alias("known"),
        F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))).alias("seg"),
    ).withColumn("line", F.when(own == F.col("seg"), F.col("line")))
    order = W.partitionBy("conv", "seg").orderBy("pos")
    found = placed.select(
        "*", F.coalesce(F.lag("blank").over(order), F.lit(True)).alias("after_blank"),
        F.coalesce(F.lag("known").over(order), F.when(F.col("pos") == 0, START)).alias("before"),
    ).filter(own == F.col("seg"))
    seen = marker(F.col("line")) * SHAPES + shape(F.col("line"), F.col("after_blank"))
    return work.keep(found.select("conv", "pos", "seg", "line", seen.cast("int").alias("seen"), "known", "before"), "lines")


@dataclass
class Model:
    """Log probabilities; a few hundred numbers."""

    steps: np.ndarray  # from state (or START) to state
    seen: np.ndarray  # of what is seen in a state

    def segment(self, seen: np.ndarray) -> np.ndarray:
        """Best score from each state before the lines to each state at their end."""
        best = self.steps + self.seen[:, seen[0]]
        for line in seen[1:]:
            best = (best[:, :, None] + self.steps[None, :STATES]).max(axis=1) + self.seen[:, line]
        return best

    def path(self, seen: np.ndarray, before: int, last: int) -> np.ndarray:
        """Best states of the lines between two given ones."""
        scores, back = self.steps[before] + self.seen[:, seen[0]], []
        for line in seen[1:]:
            ways = scores[:, None] + self.steps[:STATES]
            back.append(ways.argmax(axis=0))
            scores = ways.max(axis=0) + self.seen[:, line]
        states = [last]
        for choice in reversed(back):
            states.append(choice[states[-1]])
        return np.array(states[::-1])


def _prior() -> tuple[np.ndarray, np.ndarray]:
    steps = np.full((STATES + 1, STATES), 0.01)
    seen = np.full((STATES, MARKERS * SHAPES), 0.05)
    for role in range(len(ROLES)):
        begin, inside = 2 * role, 2 * role + 1
        steps[[begin, inside], inside] += 2
        for other in range(len(ROLES)):
            if other != role:
                steps[[begin, inside], 2 * other] += 1 if other else 0.1
        steps[START, begin] += 1
        seen[begin, (role + 1) * SHAPES : (role + 2) * SHAPES] += 2
        seen[[begin, inside], :SHAPES] += 0.5
    return steps, seen


def fit(lines: DataFrame) -> Model:
    """Counts over the lines whose state is known."""
    steps, seen = _prior()
    known = lines.select("known", "seen", "before").filter("known IS NOT NULL")
    for row in known.groupBy("before", "known", "seen").count().collect():
        if row["before"] is not None:
            steps[row["before"], row["known"]] += row["count"]
        seen[row["known"], row["seen"]] += row["count"]
    blocked = steps <= 0
    steps, seen = np.log(steps / steps.sum(1, keepdims=True)), np.log(seen / seen.sum(1, keepdims=True))
    steps[blocked] = NEVER
    return Model(steps, seen)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :STATES]).max(axis=1)


def _grouped(df: DataFrame, keys: list[str], order: str, make, schema: str) -> DataFrame:
    """Rows of each group, in order, through ``make`` (columns as arrays -> columns as
    lists).  Groups of one partition stream by; the last one of a batch waits for the
    next batch.  No group is larger than SEGMENT rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, ended = None, False
        for batch in _with_end(batches):
            ended = batch is None
            rows = waiting if ended else batch.to_pandas()
            if not ended and waiting is not None:
                rows = pd.concat([waiting, rows], ignore_index=True)
            if rows is None or rows.empty:
                continue
            changes = np.zeros(len(rows), dtype=bool)
            for key in keys:
                changes |= (rows[key] != rows[key].shift()).to_numpy()
            starts = np.flatnonzero(changes).tolist()
            ends = [*starts[1:], len(rows)]
            if not ended:
                waiting = rows.iloc[starts.pop():]
                ends.pop()
            columns = {c: rows[c].to_numpy() for c in rows.columns}
            made: dict[str, list] = {}
            for start, end in zip(starts, ends):
                for name, values in make({c: v[start:end] for c, v in columns.items()}).items():
                    made.setdefault(name, []).extend(values)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in fields], schema=fields)

    fields = arrow_schema(df.sparkSession, schema)
    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _matrices(group: dict) -> list[np.ndarray]:
    return [np.asarray(m).reshape(STATES + 1, STATES) for m in group["best"]]


def states(lines: DataFrame, model: Model, work: WorkTables) -> DataFrame:
    """Lines with their best state."""
    shared = lines.sparkSession.sparkContext.broadcast(model)

    def summed(group: dict) -> dict[str, list]:
        best = shared.value.segment(group["seen"])
        return {"conv": group["conv"][:1], "node": group["seg"][:1], "best": [best.ravel()]}

    def multiplied(group: dict) -> dict[str, list]:
        best = reduce(_product, _matrices(group))
        return {"conv": group["conv"][:1], "node": group["up"][:1], "best": [best.ravel()]}

    def handed_down(group: dict) -> dict[str, list]:
        before, last = int(group["up_before"][0]), int(group["up_last"][0])
        matrices = _matrices(group)
        scores, back = matrices[0][before], []
        for matrix in matrices[1:]:
            ways = scores[:, None] + matrix[:STATES]
            back.append(ways.argmax(axis=0))
            scores = ways.max(axis=0)
        ends = [last]
        for choice in reversed(back):
            ends.append(int(choice[ends[-1]]))
        ends.reverse()
        return {"conv": group["conv"], "node": group["node"], "before": [before, *ends[:-1]], "last": ends}

    def resolved(group: dict) -> dict[str, list]:
        path = shared.value.path(group["seen"], int(group["before"][0]), int(group["last"][0]))
        return {**{c: group[c] for c in ("conv", "pos", "seg", "line")}, "state": path}

    matrix = "conv string, node long, best array<double>"
    narrow = lines.select("conv", "seg", "pos", "seen")
    levels = [work.keep(_grouped(narrow, ["conv", "seg"], "pos", summed, matrix), "level")]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        up = levels[-1].withColumn("up", F.floor(F.col("node") / SEGMENT))
        levels.append(work.keep(_grouped(up, ["conv", "up"], "node", multiplied, matrix), "level"))
    best = F.slice("best", START * STATES + 1, STATES)
    ends = levels[-1].select(
        "conv", "node", F.lit(START).cast("long").alias("before"),
        (F.array_position(best, F.array_max(best)) - 1).alias("last"),
    )
    for level in reversed(levels[:-1]):
        above = ends.select("conv", F.col("node").alias("up"), F.col("before").alias("up_before"), F.col("last").alias("up_last"))
        rows = level.withColumn("up", F.floor(F.col("node") / SEGMENT)).join(above, ["conv", "up"])
        ends = work.keep(
            _grouped(rows, ["conv", "up"], "node", handed_down, "conv string, node long, before long, last long"),
            "ends",
        )
    given = ends.withColumnRenamed("node", "seg")
    return _grouped(
        lines.select("conv", "seg", "pos", "line", "seen").join(given, ["conv", "seg"]), ["conv", "seg"], "pos",
        resolved, "conv string, pos long, seg long, line string, state int",
    )


def turns(resolved: DataFrame, work: WorkTables) -> DataFrame:
    """(conv, turn, role, n_lines, text): consecutive lines of one turn, markers taken off."""
    lines = work.keep(
        resolved.select("*", ((F.col("state") % 2 == 0) | (F.col("pos") == 0)).cast("long").alias("begins")), "resolved"
    )
    # turns are numbered by counting beginnings: inside a segment, after those before it
    counts = lines.groupBy("conv", "seg").agg(F.sum("begins").alias("n"))
    earlier = W.partitionBy("conv").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    counts = work.keep(
        counts.select("conv", "seg", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before")), "turn-counts"
    )
    inside = W.partitionBy("conv", "seg").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    numbered = lines.withColumn("nth", F.sum("begins").over(inside)).join(counts, ["conv", "seg"]).select(
        "conv", (F.col("nth") + F.col("n_before") - 1).alias("turn"), "pos",
        F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.floor(F.col("state") / 2).cast("int") + 1).alias("role"),
        F.when(F.col("begins") == 1, without_marker(F.col("line"))).otherwise(F.col("line")).alias("line"),
    )
    return numbered.groupBy("conv", "turn").agg(
        F.min_by("role", "pos").alias("role"), F.count("*").alias("n_lines"),
        F.btrim(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n"),
            F.lit(" \t\r\n"),
        ).alias("text"),
    )


def rendered(role: Column, text: Column) -> Column:
    """A turn in canonical form."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def parse(transcripts: DataFrame, work: WorkTables | None = None) -> DataFrame:
    """Turns of transcripts given as parts (conv, part, text, known)."""
    work = work or WorkTables(transcripts.sparkSession)
    lines = lines_of(transcripts, work)
    found = turns(states(lines, fit(lines), work), work)
    return found.withColumn("rendered", rendered(F.col("role"), F.col("text")))
