"""Rendezvous sharding against the same law in Python."""

import math
import struct
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from codeloom.llm.sharding import assign_shards, rendezvous, write_shards


def shard_of(key, weights):
    best = []
    for s, w in enumerate(weights):
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", s), h)
        best.append((-math.log(((h >> 12) + 0.5) / 2**52) / w, s))
    return min(best)[1]


def test_rows_equal_brute_force(make_docs):
    texts = {i: "é" * (i % 50) for i in range(300)} | {400: None, 401: ""}
    rows = assign_shards(make_docs(texts), [1.0] * 24).collect()
    assert len(rows) == len(texts)
    for r in rows:
        body = (texts[r.key] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 8, zlib.crc32(body))
        assert r.shard == shard_of(r.key, [1.0] * 24)
        assert r.grown_shard == shard_of(r.key, [1.0] * 25)
        assert r.grown_shard in (r.shard, 24)
    for shard, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))


def test_shares_follow_weights_and_few_rows_move(spark):
    keys = spark.range(40_000)
    weights = [1.0, 2.0, 4.0, 1.0]
    rows = keys.select(
        rendezvous(F.col("id"), weights).alias("a"), rendezvous(F.col("id"), [*weights, 2.0]).alias("b")
    ).groupBy("a", "b").count().collect()
    total = Counter()
    for r in rows:
        assert r.b in (r.a, 4)
        total[r.a] += r["count"]
    for s, w in enumerate(weights):
        assert abs(total[s] / 40_000 - w / 8) < 0.02
    assert abs(sum(r["count"] for r in rows if r.b == 4) / 40_000 - 0.2) < 0.02


def test_null_and_repeated_keys_and_empty_tables(make_docs):
    rows = assign_shards(make_docs([(None, "a"), (None, "b"), (5, "x"), (5, "x")]), [1.0] * 3).collect()
    for key in (None, 5):
        own = [r for r in rows if r.key == key]
        assert len({r.shard for r in own}) == 1
        assert len({(r.shard, r.slot) for r in own}) == 2
    assert assign_shards(make_docs([]), [1.0] * 3).collect() == []


def test_plan_has_no_python(make_docs):
    placed = assign_shards(make_docs({1: "x"}).withColumn("shard", F.lit("s")), [1.0] * 24)
    assert "Python" not in placed._jdf.queryExecution().toString()


def test_shards_are_written_as_folders(spark, make_docs, tmp_path):
    docs = make_docs({i: str(i) for i in range(50)})
    write_shards(docs, [1.0, 1.0], str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50
    assert {r.shard for r in back.select("shard").distinct().collect()} == {0, 1}
