"""WARC archives: deduplicated writing, and reading with segment reassembly.

Writing uses DataFrame functions only. Each page is a `response` record, or a
`revisit` of the page with the same payload digest and the least id. A block
over SEGMENT_BYTES is cut into a first record and `continuation` records, which
name its record id and carry segment numbers. Payloads over CHUNK_BYTES are sent
in chunked transfer framing. A record ends with two line breaks, which is the
line separator of Spark's text sink, so the sink writes archives, with its commit
protocol, to any store that Spark reaches. SEGMENT_BYTES * FILE_RECORDS bounds a
file's size.

Reading parses archives by their records' lengths. Records that are cut in
segments are grouped by the origin's id, put in the order of their segment
numbers and checked against the total length; chunked framing is then undone,
and the payload is checked against the record's digest. An archive that breaks
these rules raises an error.

Defined cases: null html is an empty payload; null page ids and urls are
written without the header; pages of one id and payload are written each, under
record ids drawn at random, and read back each; an empty table gives no records; extra columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget_at_exit, scratch_path, written

SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 64 << 10, 16 << 10, 2048
#: Repeated digests up to this number (about 60 bytes each) are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000
CRLF = "\r\n"
BREAK = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("origin", T.StringType()), T.StructField("segment", T.LongType()), T.StructField("total", T.LongType()), T.StructField("block", T.BinaryType()),
])


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary: four letters for each twenty bits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _pieces(data: Column, size: int) -> Column:
    """A binary cut into an array of binaries of `size` bytes; an empty one gives one empty piece."""
    last = F.greatest(F.ceil(F.octet_length(data) / F.lit(size)).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _raw(data: Column) -> Column:
    """A binary's bytes as a string column, byte for byte."""
    return data.cast("string")


def _uuid(of: Column) -> Column:
    digest = F.md5(of.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def _record_id(page: Column, digest: Column) -> Column:
    return _uuid(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("null")), digest))


def with_origins(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, first, twice, first_twice): first is the least page id with the same payload, where
    there is more than one such page; twice tells whether there are several rows of this page id and payload, first_twice of the first."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    counts = rows.groupBy("digest").agg(F.min(F.when(F.octet_length("payload") >= min_bytes, F.col("page_id"))).alias("first"), F.count("*").alias("n"))
    repeated = written(counts.filter("n > 1").drop("n"), "repeated")
    few = repeated.count() <= BROADCAST_ROWS
    side = F.broadcast(repeated) if few else repeated
    same = rows.select("digest", "page_id").join(side, "digest").groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.first("first").alias("first")).filter("n > 1")
    same = written(same.select("digest", F.col("page_id").alias("_page"), F.lit(True).alias("_same"), F.coalesce(F.col("page_id") == F.col("first"), F.lit(False)).alias("_is_first")), "same")
    of_first = same.filter("_is_first").select("digest", F.lit(True).alias("first_twice"))
    marked = written(repeated.join(of_first, "digest", "left").select("digest", "first", F.coalesce("first_twice", F.lit(False)).alias("first_twice")), "repeated")
    r, t = rows.join(F.broadcast(marked) if few else marked, "digest", "left").alias("r"), (F.broadcast(same) if few else same).alias("t")
    both = r.join(t, (F.col("r.digest") == F.col("t.digest")) & F.col("page_id").eqNullSafe(F.col("_page")), "left")
    return both.select("page_id", "url", "payload", "r.digest", "first", F.coalesce("_same", F.lit(False)).alias("twice"), F.coalesce("first_twice", F.lit(False)).alias("first_twice"))


def archive_records(pages: DataFrame, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each record, its bytes without the closing line breaks as a string column `value`."""
    rows = with_origins(pages, min_bytes)
    size, payload = F.octet_length("payload"), F.col("payload")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    chunked = size > chunk_bytes
    framed = F.concat(
        F.array_join(F.transform(_pieces(payload, chunk_bytes), lambda p: F.concat(F.lower(F.hex(F.octet_length(p))), F.lit(CRLF), _raw(p), F.lit(CRLF))), ""), F.lit("0" + BREAK)
    )
    head = F.concat(
        F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF),
        F.when(chunked & ~revisit, F.lit("Transfer-Encoding: chunked" + CRLF)).otherwise(F.concat(F.lit("Content-Length: "), size.cast("string"), F.lit(CRLF))),
        F.lit(CRLF),
    )
    block = F.when(revisit, head).when(chunked, F.concat(head, framed)).otherwise(F.concat(head, _raw(payload))).cast("binary")
    made = rows.select("page_id", "url", "digest", "first", revisit.alias("revisit"), F.when(F.col("twice"), F.expr("concat('<urn:uuid:', uuid(), '>')")).otherwise(_record_id(F.col("page_id"), F.col("digest"))).alias("record_id"), "first_twice", block.alias("block"))
    cut = made.select("*", F.octet_length("block").alias("total"), F.posexplode(_pieces(F.col("block"), segment_bytes)).alias("at", "part"))
    whole, first = F.col("total") <= segment_bytes, F.col("at") == 0
    last = (F.col("at") + 1) * segment_bytes >= F.col("total")
    kind = F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")
    headers = [
        F.lit("WARC/1.1" + CRLF),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", F.when(first, F.col("record_id")).otherwise(_uuid(F.concat_ws("|", "record_id", "at")))),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", F.when(first, F.regexp_replace("url", r"[\r\n]", " "))),
        _header("WARC-Page-ID", F.when(first, F.col("page_id"))),
        _header("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), "digest"))),
        _header("WARC-Profile", F.when(first & F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("WARC-Refers-To", F.when(first & F.col("revisit") & ~F.col("first_twice"), _record_id(F.col("first"), F.col("digest")))),
        _header("WARC-Refers-To-Page-ID", F.when(first & F.col("revisit"), F.col("first"))),
        _header("WARC-Segment-Number", F.when(~whole, F.col("at") + 1)),
        _header("WARC-Segment-Origin-ID", F.when(~first, F.col("record_id"))),
        _header("WARC-Segment-Total-Length", F.when(~whole & last, F.col("total"))),
        _header("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
        _header("Content-Length", F.octet_length("part")),
    ]
    return cut.select(F.concat(*headers, F.lit(CRLF), _raw(F.col("part"))).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, file_records: int = FILE_RECORDS) -> None:
    records = archive_records(pages, min_bytes, segment_bytes, chunk_bytes)
    records.write.option("lineSep", BREAK).option("maxRecordsPerFile", file_records).text(path)


def parse_records(data: bytes):
    """(headers, block) of each record of an archive; names of headers are in lower case."""
    at = 0
    while at < len(data):
        end = data.find(BREAK.encode(), at)
        if not data.startswith(b"WARC/1.", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8").split(CRLF)[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start, size = end + len(BREAK), int(headers["content-length"])
        block = data[start : start + size]
        at = start + size + len(BREAK)
        if len(block) < size or data[at - len(BREAK) : at] != BREAK.encode():
            raise ValueError("a record's length doesn't hold")
        yield headers, block


def dechunk(data: bytes) -> bytes:
    """The body in chunked transfer framing; trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk's length doesn't hold")
        out.append(data[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> tuple[bytes, int | None]:
    """(body, length that the headers state) of an HTTP response."""
    head, _, body = block.partition(BREAK.encode())
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("latin-1").split(CRLF)[1:])}
    if headers.get("transfer-encoding", "").lower() == "chunked":
        return dechunk(body), None
    return body, int(headers["content-length"]) if "content-length" in headers else None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under the path, segments apart."""

    def number(headers, name):
        return int(headers[name]) if name in headers else None

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for h, block in parse_records(content.as_buffer().to_pybytes()):
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    rows.append((h["warc-record-id"], h["warc-type"], number(h, "warc-page-id"), h.get("warc-target-uri"), number(h, "warc-refers-to-page-id"), digest, h.get("warc-segment-origin-id"), number(h, "warc-segment-number"), number(h, "warc-segment-total-length"), block))
                    held += len(block)
                    if held > 4 << 20:
                        yield record_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield record_batch(rows)

    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def record_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], RECORD.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Records with whole blocks: those in segments are put together. Repeated rows of one record count as so many records."""
    single = records.filter("segment is null").select("record_type", "page_id", "url", "refers_to", "digest", "block", F.lit(1).alias("copies"), F.lit(None).cast("array<long>").alias("numbers"), F.lit(None).cast("long").alias("total"))
    parts = records.filter("segment is not null").withColumn("of", F.coalesce("origin", "record_id"))
    each = parts.groupBy("of", "segment").agg(*(F.max(c).alias(c) for c in ("page_id", "url", "refers_to", "digest", "total")), F.max(F.when(F.col("origin").isNull(), F.col("record_type"))).alias("record_type"), F.max("block").alias("block"), F.count("*").alias("copies"))
    ordered = F.array_sort(F.collect_list(F.struct("segment", "block")))
    joined = each.groupBy("of").agg(*(F.max(c).alias(c) for c in ("record_type", "page_id", "url", "refers_to", "digest", "total", "copies")), ordered.alias("parts"))
    whole = joined.select("record_type", "page_id", "url", "refers_to", "digest", F.array_join(F.transform("parts", lambda p: _raw(p["block"])), "").cast("binary").alias("block"), F.col("copies").cast("int").alias("copies"), F.transform("parts", lambda p: p["segment"]).alias("numbers"), "total")
    return single.unionByName(whole)


def read_pages(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row for each page in the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and on demand the payload of responses."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["numbers"] is not None and (r["numbers"] != list(range(1, len(r["numbers"]) + 1)) or r["total"] != len(r["block"])):
                    raise ValueError(f"segments of page {r['page_id']} don't make up its record")
                payload, stated = http_payload(r["block"])
                if r["record_type"] == "revisit":
                    size, digest = stated, r["digest"]
                else:
                    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if digest != r["digest"] or stated not in (None, size):
                        raise ValueError(f"the payload of page {r['page_id']} doesn't match its record")
                kept = payload if with_payload and r["record_type"] == "response" else None
                out += [(r["page_id"], r["url"], size, digest, r["record_type"], r["refers_to"], kept)] * r["copies"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    found = reassemble(read_records(spark, path)).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return found if with_payload else found.drop("payload")


def archived_pages(pages: DataFrame) -> DataFrame:
    """The columns that op3 returns, read back from archives written of the pages."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    forget_at_exit(pages.sparkSession, path)
    return read_pages(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, payload_bytes, h,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (('0x' || substr(h, (i // 4 * 5 + 1)::BIGINT, 5))::INT >> (15 - i % 4 * 5)::INT & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
    min(page_id) OVER (PARTITION BY h) AS first
  FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM d
"""
