"""WARC: archives written and read back, cut records, text that looks like a record."""

import hashlib
import random
from base64 import b32encode

import pytest
from pyspark.sql import functions as F

from codeloom.functions.work import WorkTables
from codeloom.llm import warc

PAGES = "page_id long, url string, html string"


def brute(rows):
    first = {}
    for page_id, _, html in rows:
        first[html or ""] = min(page_id, first.get(html or "", page_id))
    rows = [
        (
            p, len((h or "").encode()), b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
            "response" if first[h or ""] == p else "revisit", None if first[h or ""] == p else first[h or ""], True,
        )
        for p, _, h in rows
    ]
    return sorted(rows, key=str)


def round_trip(spark, rows, size):
    work = WorkTables(spark)
    path = f"{work.folder}/archives"
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), path, size=size, work=work)
    got = warc.read_records(spark, path).collect()
    return path, sorted(
        ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.verified) for r in got),
        key=str,
    )


@pytest.mark.parametrize("size", [7, 64, 1 << 16])
def test_records_come_back(spark, size):
    rng = random.Random(size)
    parts = ["a", "é", "😀", "\r\n", "\n", "WARC/1.1", "WARC/1.1\r\n", "\r\n\r\nWARC/1.1\r\n", "WARC-Type: x\r\n", " "]
    rows = [(i, f"http://h/{i}", "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nWARC-Type: no", ""), (90, "http://é", rows[5][2]), (91, "x", rows[5][2])]
    rows += [(102, "x", "\r\n\r\nWARC/1.1\r\n"), (103, "x", "WARC/1.1"), (104, "x", "\r\nWARC/1.1\r\n\r\nWARC/1.1")]
    path, got = round_trip(spark, rows, size)
    assert got == brute(rows)
    text = b"".join(
        bytes(r.content) for r in spark.read.format("binaryFile").load(path).orderBy("path").collect()
    )
    assert text.count(b"WARC-Record-ID: <urn:x-page:") >= len(rows)
    assert b"WARC-Type: continuation" in text


def test_long_payloads_are_cut_and_put_together(spark):
    rows = [(1, "u", "<p>é</p>" * 60_000), (2, "u", "<p>é</p>" * 60_000), (3, "u", "short")]
    assert round_trip(spark, rows, 1 << 14)[1] == brute(rows)
    table = warc.chunk_table(warc.records(spark.createDataFrame(rows, PAGES), WorkTables(spark)), 1 << 14)
    assert table.filter("page_id = 1").count() > 30
    assert table.agg(F.max(F.octet_length("data"))).first()[0] <= 1 << 14


def test_missing_chunks_are_noticed(spark):
    path, _ = round_trip(spark, [(1, "u", "abcdefghij" * 10)], 16)
    chunks = warc.read_chunks(spark, path).filter("chunk <> 3")
    assert [r.complete for r in warc._joined(chunks).collect()] == [False]


def test_repeated_rows_missing_ids_and_empty_table(spark):
    rows = [(1, "u", "x"), (1, "u", "x"), (2, "u", "x"), (None, "u", "x"), (None, "u", "y")]
    got = round_trip(spark, rows, 64)[1]
    assert sorted((str(r[0]), r[3], str(r[4])) for r in got) == [
        ("1", "response", "None"), ("1", "response", "None"), ("2", "revisit", "1"),
        ("None", "response", "None"), ("None", "revisit", "1"),
    ]
    assert round_trip(spark, [], 64)[1] == []


def test_a_payload_full_of_version_marks_takes_seconds(spark, tmp_path):
    import time

    rows = [(1, "http://a", "WARC/1.1" * 60_000), (2, "http://b", "x" * 65_533 + "WARC/1.1é" * 3), (3, "http://c", "WARC/1.")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    start = time.time()
    warc.write_archives(pages, str(tmp_path / "marks"))
    got = {r.page_id: r for r in warc.read_records(spark, str(tmp_path / "marks")).collect()}
    assert all(got[i].verified and got[i].payload_bytes == len(html.encode()) for i, _, html in rows)
    assert time.time() - start < 60
