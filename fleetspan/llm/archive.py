"""WARC archives written and read as tables of chunked records."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 16
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")  # fixed values: digits of base 32, RFC 4648 alphabet
_CHUNKS = "page_id long, url string, chunk long, chunks long, part string, part_bytes long, digest_so_far string, digest string, payload_bytes long"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base-32 text of a hexadecimal SHA-1: five hexadecimal digits make four."""
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), *_BASE32)


def chunk_table(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per record and chunk: its text, the running SHA-1 up to and with it, the whole record's digest and size.

    A record is never copied whole: the digest is carried from chunk to chunk, and a batch of chunk rows is sent on as soon
    as it holds a few megabytes. Null payloads are empty; an empty payload has one empty chunk.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _CHUNKS.split(", ")]
        types = [pa.string() if f.endswith("string") else pa.int64() for f in _CHUNKS.split(", ")]
        schema = pa.schema(list(zip(names, types)))

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)

        rows, held = [], 0
        for b in batches:
            for key, address, payload in zip(*(b.column(i) for i in range(3))):
                # slices of the Arrow buffer: the payload is never copied whole
                held_here = memoryview(payload.as_buffer()) if payload.is_valid else memoryview(b"")
                ends = [0]
                while ends[-1] < len(held_here):
                    end = min(ends[-1] + chunk_bytes, len(held_here))
                    while end < len(held_here) and held_here[end] & 0xC0 == 0x80 and end > ends[-1] + 1:
                        end -= 1
                    if end < len(held_here) and held_here[end] & 0xC0 == 0x80:  # a character longer than a chunk
                        end = next((e for e in range(end + 1, len(held_here)) if held_here[e] & 0xC0 != 0x80), len(held_here))
                    ends.append(end)
                ends = ends if len(ends) > 1 else [0, 0]
                n, digest = len(ends) - 1, hashlib.sha1()
                for x, y in zip(ends, ends[1:]):  # first reading: the digest, chunk by chunk
                    digest.update(held_here[x:y])
                final, running, total = digest.hexdigest(), hashlib.sha1(), len(held_here)
                for k, (x, y) in enumerate(zip(ends, ends[1:])):
                    raw = held_here[x:y]
                    part = str(raw, "utf-8")
                    if n > 1:
                        running.update(raw)
                    rows.append((key.as_py(), address.as_py(), k, n, part, len(raw), running.hexdigest() if n > 1 else final, final, total))
                    held += len(raw)
                    if held > 4 << 20 or len(rows) >= 2000:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(cut, _CHUNKS)


def _separator(run: str) -> str:
    # a field that no payload can hold, as the run's name is drawn anew
    return f"\r\n\r\nWARC/1.1\r\nX-Archive-Run: {run}\r\n"


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", chunk_bytes: int = CHUNK_BYTES, least_bytes: int = 0) -> str:
    """Write a WARC/1.1 record per page below ``folder``, as gzip files, and return the run's name for the reader.

    Of records with equal payloads of ``least_bytes`` or more, the one with the smallest page_id is a response and the
    others are revisits of it, without payload; rows that repeat the smallest page_id are responses too. Payloads of more
    than ``chunk_bytes`` bytes are segmented: a first record and continuation records with segment numbers, one row
    of the job each. Spark's text writer makes the files, so any file system it knows will do. Null page_ids sort last.
    """
    run = uuid.uuid4().hex
    chunks = chunk_table(pages, page_id, url, html, chunk_bytes)
    heads = chunks.where("chunk = 0").select("page_id", "digest", "payload_bytes")
    # only payloads that occur under several ids need a decision; Spark broadcasts the table when it is small
    shared = heads.groupBy("digest", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("payload_bytes") >= least_bytes)).drop("n")
    rows = chunks.join(shared, ["digest", "payload_bytes"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.withColumn("revisit", revisit).where(~F.col("revisit") | (F.col("chunk") == 0))
    end = "\r\n"
    when = lambda test, *parts: F.when(test, F.concat(*parts, F.lit(end))).otherwise("")
    first, many = F.col("chunk") == 0, (F.col("chunks") > 1) & ~F.col("revisit")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kind = F.when(F.col("revisit"), "revisit").when(first, "response").otherwise("continuation")
    origin = F.concat(F.lit("<urn:uuid:"), F.expr("uuid_of"), F.lit(">"))
    ids = F.sha2(F.concat_ws(" ", F.lit(run), text("page_id"), F.col("digest")), 256)
    as_uuid = lambda h: F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    rows = rows.withColumn("uuid_of", as_uuid(ids)).withColumn("own", F.when(first, F.col("uuid_of")).otherwise(as_uuid(F.sha2(F.concat_ws(" ", ids, F.col("chunk").cast("string")), 256))))
    header = F.concat(
        F.concat(F.lit("WARC-Type: "), kind, F.lit(end)), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), F.col("own"), F.lit(">" + end)), F.lit("WARC-Date: 2000-01-01T00:00:00Z" + end),
        when(F.col("url").isNotNull(), F.lit("WARC-Target-URI: "), F.regexp_replace(text("url"), r"\s", "%20")), when(F.col("page_id").isNotNull(), F.lit("X-Page-ID: "), text("page_id")),
        when(first, F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("digest"))), when(first, F.lit("X-Payload-Length: "), text("payload_bytes")),
        when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), when(F.col("revisit"), F.lit("X-Refers-To-Page: "), text("first_id")),
        when(many, F.lit("WARC-Segment-Number: "), (F.col("chunk") + 1).cast("string")), when(~first, F.lit("WARC-Segment-Origin-ID: "), origin),
        when(many & (F.col("chunk") + 1 == F.col("chunks")), F.lit("WARC-Segment-Total-Length: "), text("payload_bytes")), when(many, F.lit("X-Running-Digest: sha1:"), base32_of_hex(F.col("digest_so_far"))),
        when(many, F.lit("WARC-Block-Digest: sha1:"), F.sha1(F.col("part").cast("binary"))), when(F.lit(True), F.lit("Content-Type: text/html")), F.lit("Content-Length: "), F.when(F.col("revisit"), "0").otherwise(text("part_bytes")), F.lit(end + end),
    )
    body = F.when(F.col("revisit"), "").otherwise(F.col("part"))
    # a line is a record with its closing blank lines but the last line feed, which the writer adds
    out = rows.select(F.concat(F.lit(f"WARC/1.1\r\nX-Archive-Run: {run}\r\n"), header, body, F.lit("\r\n\r")).alias("value"))
    out.write.option("compression", "gzip").option("lineSep", "\n").text(folder)
    return run


def read_archives(spark: SparkSession, folder: str, run: str) -> DataFrame:
    """The pages behind archives of a run, one row each: page_id, url, sizes as read, digest, record type, page referred to, and intact.

    intact: all segments are there, sizes add up, and the digest of every block as read is the one that its record states: that
    of the payload, or of the segment. Blocks stay segmented, so no payload is put together. An archive
    without records gives no rows.
    """
    raw = spark.read.option("lineSep", _separator(run)).text(folder)
    # the first record of a file keeps its version line, the last its closing blank lines
    value = F.regexp_replace(F.regexp_replace("value", f"^WARC/1\\.1\r\nX-Archive-Run: {run}\r\n", ""), "^\\s*$", "")
    cut = F.locate("\r\n\r\n", F.col("v"))
    rows = raw.select(value.alias("v")).where("v <> ''").select(F.substring("v", F.lit(1), cut + 1).alias("head"), F.expr("substring(v, locate('\\r\\n\\r\\n', v) + 4)").alias("rest"))
    get = lambda f: F.nullif(F.regexp_extract("head", f"(?m)^{f}: ([^\r\n]*)$", 1), F.lit(""))
    length = get("Content-Length").cast("long")
    rows = rows.withColumn("block", F.when(F.octet_length("rest") > length, F.regexp_replace("rest", "\r\n\r\n$", "")).otherwise(F.col("rest")))
    rows = rows.select(
        get("WARC-Type").alias("type"), get("X-Page-ID").cast("long").alias("page_id"), get("WARC-Target-URI").alias("url"), get("WARC-Payload-Digest").alias("digest"), get("X-Payload-Length").cast("long").alias("stated"),
        get("X-Refers-To-Page").cast("long").alias("refers_to"), F.coalesce(get("WARC-Segment-Origin-ID"), get("WARC-Record-ID")).alias("record"), F.coalesce(get("WARC-Segment-Number").cast("long"), F.lit(1)).alias("segment"), get("X-Running-Digest").alias("running"),
        F.octet_length("block").cast("long").alias("size"), ((F.octet_length("block") == length) & F.when(get("X-Running-Digest").isNotNull(), F.coalesce(F.concat(F.lit("sha1:"), F.sha1(F.col("block").cast("binary"))) == get("WARC-Block-Digest"), F.lit(False))).otherwise(True)).alias("whole"), F.sha1(F.col("block").cast("binary")).alias("sha1"), get("WARC-Segment-Total-Length").cast("long").alias("total"),
    )
    whole = rows.where("running is null").select("page_id", "url", F.coalesce("stated", "size").alias("payload_bytes"), F.substring("digest", 6, 32).alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", (F.col("whole") & ((F.col("type") == "revisit") | ((F.col("size") == F.col("stated")) & (F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1"))) == F.col("digest"))))).alias("intact"))
    parts = rows.where("running is not null")
    head = lambda c: F.max(F.when(F.col("type") == "response", F.col(c)))
    # repeated rows of a page share a record id: every segment then occurs as often
    joined = parts.groupBy("record", "segment").agg(F.first("type").alias("type"), head("page_id").alias("page_id"), head("url").alias("url"), head("digest").alias("digest"), head("stated").alias("stated"), F.max("total").alias("total"), F.first("running").alias("running"), F.first("size").alias("size"), F.min("whole").alias("whole"), F.count("*").alias("times"))
    joined = joined.groupBy("record").agg(F.max("page_id").alias("page_id"), F.max("url").alias("url"), F.sum("size").alias("payload_bytes"), F.max("digest").alias("digest"), F.max("stated").alias("stated"), F.max("total").alias("total"), F.max_by("running", "segment").alias("running"), F.min("whole").alias("whole"), F.max("segment").alias("last"), F.count("*").alias("n"), F.max("times").alias("times"))
    joined = joined.select("page_id", "url", "payload_bytes", F.substring("digest", 6, 32).alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), (F.col("whole") & (F.col("n") == F.col("last")) & (F.col("payload_bytes") == F.col("stated")) & (F.col("total") == F.col("stated")) & (F.col("running") == F.col("digest"))).alias("intact"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_t")).drop("_t")
    return whole.unionByName(joined)
