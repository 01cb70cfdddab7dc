"""WARC archives as a chunked record table.

A payload is cut into chunks, rows of (record, chunk number, bytes), so that nothing
behind the table handles a whole large record.  A chunk is written as one WARC
record: the first as ``response``, further ones as ``continuation`` segments, as the
format provides for records that are cut.  Spark's text writer puts the rows into the
archives, and its reader takes them apart again at the line that starts a record, so
both work on any file system and large archives are read in parallel.

A chunk never contains the version mark that starts a record: where a payload holds
such text it is cut through, and so cannot be taken for a record of its own.

Records with equal payloads are written once; the others become ``revisit`` records
that refer to it.  Payloads are digested again as they are read: a record of one chunk
by itself, the chunks of a cut record one after another with a running digest.

Defined results: null html is an empty payload, and equal to other empty ones; of
rows that repeat page_id and payload of the response all are responses; a null
page_id comes after all others; a null url is written as ``urn:x-page:<id>``; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bind
from ..functions.work import WorkTables
from .common import broadcast_if, small_batches

CHUNK_BYTES = 64 << 10
VERSION = "WARC/1.1"
BETWEEN = f"\r\n\r\n{VERSION}\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# fixed value: the base32 alphabet of RFC 4648
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: 160 bits are 8 groups of 4 letters."""
    digest = F.sha1(payload)
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def records(pages: DataFrame, work: WorkTables) -> DataFrame:
    """One row per page: page_id, url, payload, digest, size, and ``first``, the
    smallest page_id of the pages with the same payload, where there are several."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long"), "url", payload.alias("payload"),
        sha1_base32(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"),
    )
    shared = work.keep(
        rows.groupBy("digest", "size")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1").drop("n"),
        "shared-payloads",
    )
    return rows.join(broadcast_if(shared, shared.count()), ["digest", "size"], "left")


def chunk_starts(payload: Column, size: int) -> Column:
    """Start positions (from 1) of a payload's chunks: every ``size`` bytes, and inside
    every version mark.  An empty payload has one empty chunk.  Marks are looked for chunk
    by chunk; one that a chunk's end cuts is cut already."""
    regular = F.sequence(F.lit(1), F.greatest(F.octet_length(payload), F.lit(1)), F.lit(size))
    mark, length = F.lit(VERSION).cast("binary"), len(VERSION)

    def cuts(start: Column) -> Column:
        chunk = F.substring(payload, start, F.lit(size))
        last = start + F.octet_length(chunk) - length
        places = F.filter(
            F.sequence(start, last), lambda at: F.substring(payload, at, F.lit(length)) == mark
        )
        inside = F.when(F.contains(chunk, mark), F.transform(places, lambda at: at + 2))
        return F.concat(F.array(start), F.coalesce(inside, F.array().cast("array<int>")))

    return F.when(F.contains(payload, mark), F.flatten(F.transform(regular, cuts))).otherwise(regular)


def chunk_table(rows: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """(rec, chunk, chunks, data, ...): the chunks of all records that carry a payload,
    and one row without data for each revisit."""
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.withColumn("rec", F.monotonically_increasing_id()).withColumn("revisit", revisit)
    starts = F.when(revisit, F.array(F.lit(1))).otherwise(
        bind(F.col("payload"), lambda payload: chunk_starts(payload, size))
    )
    rows = rows.withColumn("starts", starts)
    rows = rows.select("*", F.posexplode("starts").alias("at", "start"))
    end = F.coalesce(F.get("starts", F.col("at") + 1), F.lit(2**31 - 1))
    return rows.select(
        "rec", "page_id", "url", "digest", "size", "revisit", "first",
        (F.col("at") + 1).alias("chunk"), F.size("starts").alias("chunks"),
        F.when(F.col("revisit"), F.encode(F.lit(""), "UTF-8"))
        .otherwise(F.substring(F.col("payload"), F.col("start"), end - F.col("start"))).alias("data"),
    )


def _name(page: Column, *more: Column) -> Column:
    known = F.coalesce(page.cast("string"), F.lit(""))
    return F.concat(F.lit("<urn:x-page:"), known, *[F.concat(F.lit("/"), m.cast("string")) for m in more], F.lit(">"))


def record_text(date: str) -> Column:
    """A chunk's WARC record with the first of the two line ends after it."""
    page, first, cut = F.col("page_id"), F.col("chunk") == 1, F.col("chunks") > 1
    revisit = F.col("revisit")
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", ""), F.substring_index(_name(page), ">", 1))

    def line(name: str, value: Column, when: Column = F.lit(True)) -> Column:
        text = F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
        return F.when(when, text).otherwise(F.lit(""))

    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").when(first, "response").otherwise("continuation")),
        line("WARC-Record-ID", _name(page, F.col("rec"), F.col("chunk"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")), first),
        line("WARC-Refers-To", _name(F.col("first")), revisit),
        line("WARC-Profile", F.lit(PROFILE), revisit),
        line("X-Payload-Length", F.col("size"), revisit),
        line("WARC-Segment-Number", F.col("chunk"), cut),
        line("WARC-Segment-Origin-ID", _name(page, F.col("rec"), F.lit(1)), cut & ~first),
        line("WARC-Segment-Total-Length", F.col("size"), cut & (F.col("chunk") == F.col("chunks"))),
        line("Content-Type", F.lit("text/html; charset=UTF-8")),
        line("Content-Length", F.octet_length("data")),
        F.lit("\r\n"), F.col("data").cast("string"), F.lit("\r\n"),
    )


def write_archives(
    pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", size: int = CHUNK_BYTES,
    work: WorkTables | None = None,
) -> None:
    """One WARC record per row of ``pages`` (page_id, url, html), as many archives as
    the table has partitions."""
    work = work or WorkTables(pages.sparkSession)
    rows = chunk_table(records(pages.select("page_id", "url", "html"), work), size)
    # the line separator is the second of the two line ends behind a record
    rows.select(record_text(date).alias("value")).write.option("lineSep", "\r\n").text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The records of archives as rows: kind, page_id, rec, chunk, segment and total (of
    cut records), refers_to, declared digest and length, complete, data."""
    raw = spark.read.option("lineSep", BETWEEN).text(path)
    rows = raw.withColumn("head", F.substring_index("value", "\r\n\r\n", 1)).filter(F.length("head") > 0)

    def header(name: str) -> Column:
        found = F.regexp_extract(F.col("head"), rf"(?i)\n{name}:[ \t]*([^\r\n]*)", 1)
        return F.when(found != "", found)

    rows = rows.withColumn("head", F.concat(F.lit("\n"), F.col("head")))
    name, length = header("WARC-Record-ID"), header("Content-Length").cast("int")
    start = F.octet_length("head") + 4  # one more in front, four line end bytes behind
    number = lambda text, pattern: F.regexp_extract(text, pattern, 1).try_cast("long")
    return rows.select(
        header("WARC-Type").alias("kind"),
        number(name, r"urn:x-page:(-?\d+)").alias("page_id"),
        number(name, r"/(\d+)/").alias("rec"),
        number(name, r"/(\d+)>").alias("chunk"),
        header("WARC-Segment-Number").cast("int").alias("segment"),
        header("WARC-Segment-Total-Length").cast("long").alias("total"),
        number(header("WARC-Refers-To"), r"urn:x-page:(-?\d+)").alias("refers_to"),
        F.regexp_extract(header("WARC-Payload-Digest"), r"sha1:(\w+)", 1).alias("declared"),
        header("X-Payload-Length").cast("long").alias("declared_bytes"),
        (F.octet_length("value") - start + 1 >= length).alias("complete"),
        F.substring(F.col("value").cast("binary"), start, length).alias("data"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, record_type, refers_to, payload_bytes and payload_digest of
    the payload as it was read (of a revisit as it declares), and whether the record is
    whole and its payload is the declared one."""
    chunks = read_chunks(spark, path)
    revisit = F.col("kind") == "revisit"
    whole = chunks.filter("segment IS NULL").select(
        "page_id", F.col("kind").alias("record_type"), "refers_to",
        F.when(revisit, F.col("declared_bytes")).otherwise(F.octet_length("data")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.col("declared")).otherwise(sha1_base32(F.col("data"))).alias("payload_digest"),
        "declared", "complete",
    )
    every = whole.unionByName(_joined(chunks.filter("segment IS NOT NULL")))
    return every.withColumn(
        "verified", F.col("complete") & (F.col("payload_digest") == F.col("declared"))
    ).drop("declared", "complete")


def _joined(chunks: DataFrame) -> DataFrame:
    """Cut records: their chunks pass one after another through a running digest."""
    small_batches(chunks.sparkSession)
    ordered = (
        chunks.select("rec", "chunk", "page_id", "total", "declared", "complete", "data")
        .repartition("rec").sortWithinPartitions("rec", "chunk")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def close() -> None:
            if state is not None:
                page, declared, size, digest, total, good, count = state
                done.append((page, "response", None, size, b32encode(digest.digest()).decode(), declared, good and total == size))

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(7))):
                rec, chunk, page, total, declared, good = (v.as_py() for v in row[:6])
                if rec != now:
                    close()
                    now, state = rec, [page, "", 0, hashlib.sha1(), None, True, 0]
                data = row[6].as_buffer()
                state[1] = state[1] or declared
                state[2] += data.size
                state[3].update(data)
                state[4] = total if total is not None else state[4]
                state[6] += 1
                state[5] = state[5] and good and chunk == state[6]
            if done:
                yield _batch(done)
                done.clear()
        close()
        if done:
            yield _batch(done)

    return ordered.mapInArrow(run, _RECORD)


_RECORD = (
    "page_id long, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, declared string, complete boolean"
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
    names = [f.strip().split(" ")[0] for f in _RECORD.split(",")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names
    )
