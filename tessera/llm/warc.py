"""WARC archives with revisit records, record segmentation and chunked HTTP bodies.

Writing.  Each page becomes one response record (HTTP head and the payload in chunked transfer framing), or, if a
page with a smaller page_id has an equal payload of at least 100 bytes, a revisit record (head only) that names it.
A block longer than a segment is cut: the record itself is segment 1, the others are continuation records with
``WARC-Segment-Origin-ID`` and ``WARC-Segment-Number``; the last one carries ``WARC-Segment-Total-Length``.
Archives of a bounded size are files written by Spark's text writer (one archive a row, the record trailer as its
line end), so they are committed to any shared store and survive lost executors.

Reading.  Files are parsed record by record; complete records decode where they are, segments are grouped by origin
identifier, ordered by number, checked (each number from 1 to the last exactly once, one total length, which the joined
block has), joined and then decoded.  A joined block is one binary value, so it ends at 2 GiB.

Edge cases.  Null html is an empty payload; equal payloads below 100 bytes are all responses.  Rows that share a
page_id are separate records (record ids hold a row number); if they share the smallest page_id of equal payloads
too, all of them are responses.  A null page_id refers to the smallest known one, or is a response if there is none.
A null url leaves out the target header and is read back as null.  Empty tables write no archive.  Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, light_batches, shared_dir, sized_broadcast, slices

LEAST_BYTES = 100
CHUNK_BYTES = 1 << 16
SEGMENT_BYTES = 1 << 20
ARCHIVE_BYTES = 8 << 20
REPEATED = 100_000  # digests that are broadcast
SALT_ROWS = 1 << 14
DATE = "2024-01-01T00:00:00Z"
TRAILER = b"\r\n\r\n"
_NAMES = uuid.UUID("7c1f7a52-9c6e-4f0e-9b0a-0d6a5a8c2f11")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    out = []
    for a in range(0, len(payload), size):
        piece = payload[a : a + size]
        out += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; an error if the framing is broken or ends early."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def _head(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def records(row: int, page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page, without trailers; ``first`` is the page it revisits."""
    name = uuid.uuid5(_NAMES, f"{page_id}:{row}")
    uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    kind = "response" if first is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{'Transfer-Encoding: chunked' if first is None else f'Content-Length: {len(payload)}'}\r\n\r\n".encode()
    block = http + chunked(payload) if first is None else http
    cuts = range(0, len(block), segment)
    many = len(cuts) > 1
    for k, a in enumerate(cuts):
        piece = block[a : a + segment]
        fields = [
            ("WARC-Type", kind if k == 0 else "continuation"), ("WARC-Record-ID", f"<urn:uuid:{name if k == 0 else uuid.uuid5(name, str(k))}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", f"sha256:{digest}" if k == 0 else None), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if first is not None else None),
            ("WARC-Segment-Number", k + 1 if many else None), ("WARC-Segment-Origin-ID", f"<urn:uuid:{name}>" if k else None), ("WARC-Segment-Total-Length", len(block) if k and k == len(cuts) - 1 else None),
            ("Page-ID", page_id if k == 0 else None), ("Refers-To-Page-ID", first if k == 0 else None), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(piece)),
        ]
        yield _head(fields) + piece


def _archives(archive: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, "html", archive):
            for x in part.to_pylist():
                payload = (x["html"] or "").encode()
                for record in records(x["row"], x["page_id"], x["url"], payload, x["digest"], x["first"], segment):
                    held.append(record)
                    size += len(record)
                    if size >= archive:
                        yield pa.record_batch([pa.array([TRAILER.join(held)], pa.binary())], names=["archive"])
                        held, size = [], 0
        if held:
            yield pa.record_batch([pa.array([TRAILER.join(held)], pa.binary())], names=["archive"])

    return run


def write_archives(pages: DataFrame, out: str, archive_bytes: int = ARCHIVE_BYTES, segment_bytes: int = SEGMENT_BYTES) -> str:
    """Write ``pages(page_id, url, html)`` as WARC files under ``out``."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = light_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    equal = checkpoint(rows.where(F.octet_length("html") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1"))
    if equal.count() <= REPEATED:  # digests of repeated payloads: some 100 bytes each
        joined = rows.join(F.broadcast(equal), "digest", "left")
    else:  # a payload that many pages share is spread over as many salts as it has lots of SALT_ROWS pages
        salts = equal.withColumn("salts", F.ceil(F.col("c") / SALT_ROWS).cast("int"))
        hot = checkpoint(salts.where("salts > 1"))  # few: each stands for more than SALT_ROWS pages
        salted = salts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("digest", "salt", "least")
        of = rows.join(sized_broadcast(hot.select("digest", "salts")), "digest", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1))).cast("int"))
        joined = of.join(salted, ["digest", "salt"], "left")
    first = F.when(~F.col("least").eqNullSafe(F.col("page_id")), F.col("least"))
    made = joined.select("page_id", "url", "html", "digest", first.alias("first"), F.monotonically_increasing_id().alias("row")).mapInArrow(_archives(archive_bytes, segment_bytes), "archive binary")
    made.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", TRAILER.decode()).option("maxRecordsPerFile", 1).text(out)
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: header fields (names in lower case) and block."""
    at = 0
    while at < len(data):
        end = data.index(TRAILER, at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not start with its version")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start = end + len(TRAILER)
        at = start + int(fields["content-length"])
        if data[at : at + 4] != TRAILER:
            raise ValueError("a record does not end where its length says")
        yield fields, data[start:at]
        at += 4


_FIELDS = {"origin": pa.string(), "segment": pa.int64(), "total": pa.int64(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "digest": pa.string(), "refers_to": pa.int64(), "block": pa.binary()}
_DDL = "origin string, segment long, total long, page_id long, url string, record_type string, digest string, refers_to long, block binary"


def _number(fields: dict[str, str], name: str) -> int | None:
    return int(fields[name]) if name in fields else None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            held, size = [], 0
            for f, block in parse(content.as_buffer().to_pybytes()):
                held.append((f.get("warc-segment-origin-id", f["warc-record-id"]), _number(f, "warc-segment-number"), _number(f, "warc-segment-total-length"), _number(f, "page-id"), f.get("warc-target-uri"), f["warc-type"], f.get("warc-payload-digest"), _number(f, "refers-to-page-id"), block))
                size += len(block)
                if size > 4 << 20:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _FIELDS.values(), strict=True)], names=list(_FIELDS))
                    held, size = [], 0
            if held:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _FIELDS.values(), strict=True)], names=list(_FIELDS))


def payload_of(block: bytes) -> tuple[bytes, int]:
    """The payload of an HTTP block with its full length (which a revisit keeps in its head)."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    if fields.get("transfer-encoding") == "chunked":
        body = dechunked(body)
        return body, len(body)
    return body, int(fields.get("content-length", len(body)))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "block", 8 << 20):
        got = [payload_of(b.as_buffer().to_pybytes()) for b in batch.column("block")]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), batch.column("record_type"), batch.column("refers_to"), pc.replace_substring(batch.column("digest"), "sha256:", ""), pa.array([n for _, n in got], pa.int64()), pa.array([p for p, _ in got], pa.binary())], names=["page_id", "url", "record_type", "refers_to", "digest", "length", "payload"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each record end to end, a record at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            block = b"".join(p.as_buffer() for p in batch.column("blocks")[i].values)
            yield pa.record_batch([*(batch.column(c).slice(i, 1) for c in ("page_id", "url", "record_type", "digest", "refers_to")), pa.array([block], pa.binary())], names=["page_id", "url", "record_type", "digest", "refers_to", "block"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``: page_id, url, record_type, refers_to, digest, length, payload.

    ``digest`` and ``length`` are of the full payload as the headers tell; ``payload`` is empty for revisits.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    parts = files.mapInArrow(_parsed, _DDL)
    whole = parts.where("segment is null")
    cut = parts.where("segment is not null").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("pieces"), F.sort_array(F.collect_set("total")).alias("totals"), *(F.max(c).alias(c) for c in ("page_id", "url", "digest", "refers_to")), F.min(F.when(F.col("segment") == 1, F.col("record_type"))).alias("record_type"))
    numbers, total = F.col("pieces.segment"), F.get("totals", F.lit(0))
    length = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    sound = F.coalesce((numbers == F.sequence(F.lit(1).cast("long"), F.size("pieces").cast("long"))) & (F.size("totals") == 1) & (length == total), F.lit(False))
    whole_pieces = cut.where(F.assert_true(sound, "segments are missing, repeated or of the wrong total length").isNull())
    joined = whole_pieces.select("page_id", "url", "record_type", "digest", "refers_to", F.col("pieces.block").alias("blocks")).mapInArrow(_joined, "page_id long, url string, record_type string, digest string, refers_to long, block binary")
    names = ["page_id", "url", "record_type", "digest", "refers_to", "block"]
    return whole.select(*names).union(joined.select(*names)).mapInArrow(_decoded, "page_id long, url string, record_type string, refers_to long, digest string, length long, payload binary")


def page_records(pages: DataFrame, out: str | None = None) -> DataFrame:
    """Write ``pages``, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    The digest of a response is taken from the payload read; a revisit's comes from its header.
    """
    spark = pages.sparkSession
    back = read_archives(spark, write_archives(pages, out or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"))
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("digest"))
    return back.select("page_id", F.col("length").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", "url")


SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND least IS DISTINCT FROM page_id AND least IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND least IS DISTINCT FROM page_id THEN least END AS refers_to, url
FROM f
"""
