"""Legacy ARC archives to WARC, and WARC archives back to rows.

An ARC file starts with a version block; its second line names the version and
so the fields of every record's header line, the last of which is the declared
length of the bytes that follow.  Version 1 has five fields, version 2 ten.  The
converter reads a record by its declared length alone, never by looking for the
next header, and synthesises what a WARC record needs: an identifier (a UUID
named by URL, date, key and payload digest, the same on every run), an ISO
timestamp, a record type and SHA-1 digests of block and payload.

Of the records with equal payloads (of at least ``min_bytes``) the one with the
smallest key is a response, the others are revisits that refer to it and carry
the HTTP header only.  That header keeps the payload's length.

Every record is a gzip member of its own.  Members are gathered to images of about
IMAGE_BYTES, and these are written by Spark's own text writer, with an empty gzip
member as its line separator, so archives can go to any store that Spark can
write, tasks commit as usual, and a lost executor costs its running tasks only.  A
file holds at most ``images_per_file`` images (64 MB and one record by default),
however large the records are, and is read back by one task.

Defined results: a null payload is an empty one, a null URL is ``-``, a null key
is carried as ``-`` and read back as null (and sorts after all others for the
choice of the response).  Repeated rows give repeated records: of two rows equal
in key and payload both count as the response.  Extra columns are ignored.  An
empty table gives no rows.  White space in URLs is percent-encoded, as an ARC
header line is split on spaces.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

# Field names of the two ARC versions, in the order of the format.
FIELDS = {
    b"1": [b"URL", b"IP-address", b"Archive-date", b"Content-type", b"Archive-length"],
    b"2": [b"URL", b"IP-address", b"Archive-date", b"Content-type", b"Result-code", b"Checksum", b"Location", b"Offset", b"Filename", b"Archive-length"],
}
DATE = b"20240101000000"
IMAGE_BYTES = 4 << 20
IMAGES_PER_FILE = 16
END = b"\r\n\r\n"
#: A gzip member of no bytes: what stands between two images.
NOTHING = gzip.compress(b"", 6, mtime=0)

CONVERTED = "page_key string, url string, ip string, date string, mime string, record_id string, payload_bytes bigint, payload_digest string, block_digest string, http_head binary, block binary"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe(url: str | None) -> bytes:
    return b"%20".join((url or "-").encode("utf-8", "surrogatepass").split()) or b"-"


def arc_version_block(version: bytes, name: bytes) -> bytes:
    body = version + b" 0 lanternfish\n" + b" ".join(FIELDS[version]) + b"\n\n"
    head = [b"filedesc://" + name, b"0.0.0.0", DATE, b"text/plain"]
    head += [b"200", b"-", b"-", b"0", name] if version == b"2" else []
    return b" ".join([*head, str(len(body) - 1).encode()]) + b"\n" + body


def arc_record(version: bytes, url: bytes, body: bytes, offset: int, name: bytes) -> bytes:
    head = [url, b"0.0.0.0", DATE, b"text/html"]
    head += [b"200", b"-", b"-", str(offset).encode(), name] if version == b"2" else []
    return b" ".join([*head, str(len(body)).encode()]) + b"\n" + body + b"\n"


def pages_to_arc(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """ARC file images (name, content) of about IMAGE_BYTES, of both versions in turn."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, image, name, version = 0, [], b"", b"1"

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name.decode()], pa.string()), pa.array([b"".join(image)], pa.binary())], names=["name", "content"])

        size = 0
        for batch in batches:
            for k, u, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not image:
                    version, name = (b"1", b"2")[number % 2], b"part-%d.arc" % number
                    number += 1
                    image = [arc_version_block(version, name)]
                    size = len(image[0])
                html = (p or "").encode("utf-8", "surrogatepass") if not isinstance(p, bytes) else p
                body = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Key: %s\r\nContent-Length: %d\r\n\r\n" % (b"-" if k is None else str(k).encode(), len(html)) + html
                image.append(arc_record(version, _safe(u), body, size, name))
                size += len(image[-1])
                if size >= IMAGE_BYTES:
                    yield row()
                    image = []
        if image:
            yield row()

    return pages.select(F.col(key), F.col(url), F.col(payload)).mapInArrow(write, "name string, content binary")


def parse_arc(data: bytes) -> Iterator[tuple[list[bytes], bytes]]:
    """(header fields in version-1 order of meaning, block) of every record."""
    at = data.index(b"\n")
    length = int(data[:at].rsplit(b" ", 1)[1])
    block = data[at + 1 : at + 1 + length]
    version = block.split(b" ", 1)[0]
    if version not in FIELDS:
        raise ValueError(f"unknown ARC version {version!r}")
    fields, at = FIELDS[version], at + 1 + length
    while True:
        while data[at : at + 1] == b"\n":
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\n", at)
        head = data[at:end].split(b" ")
        if len(head) != len(fields):
            raise ValueError(f"ARC header of {len(head)} fields, version {version.decode()} has {len(fields)}")
        length = int(head[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) != length:
            raise ValueError("ARC record shorter than declared")
        yield head, block
        at = end + 1 + length


def convert(arcs: DataFrame, content: str = "content") -> DataFrame:
    """WARC response records, one a row (CONVERTED), of ARC file images."""

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_key", pa.string()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("record_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block_digest", pa.string()), ("http_head", pa.binary()), ("block", pa.binary())])
        for batch in batches:
            for image in batch.column(0):
                rows = []
                for head, block in parse_arc(image.as_py()):
                    url, ip, stamp, mime = (x.decode("utf-8", "replace") for x in head[:4])
                    top, _, payload = block.partition(b"\r\n\r\n")
                    found = [x for x in top.split(b"\r\n") if x.startswith(b"X-Key: ")]
                    k = found[0][7:].decode() if found else "-"
                    own = digest(payload)
                    date = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {date} {k} {own}")
                    rows.append((k, url, ip, date, mime, f"<urn:uuid:{name}>", len(payload), own, digest(block), top + b"\r\n\r\n", block))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return arcs.select(content).mapInArrow(converted, CONVERTED)


def mark_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The records with ``record_type`` and, for revisits, what they refer to.

    The choice is made on narrow rows by partial aggregation; payloads are
    joined to it by digest, and a hot digest is split by Spark's skew join.
    """
    rank = F.coalesce(F.col("page_key").try_cast("decimal(20,0)"), F.lit("99999999999999999999").cast("decimal(20,0)"))
    firsts = records.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("d")).agg(F.min(F.struct(rank.alias("rank"), "page_key", "record_id", "url", "date")).alias("first"))
    met = records.join(firsts, records["payload_digest"] == firsts["d"], "left")
    again = F.coalesce(F.col("page_key") != F.col("first.page_key"), F.lit(False))
    return met.withColumn("record_type", F.when(again, F.lit("revisit")).otherwise(F.lit("response")))


def record_text(marked: DataFrame) -> DataFrame:
    """One column ``record`` (binary): header and block of a WARC record."""
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.col("http_head")).otherwise(F.col("block"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Page-Key", F.col("page_key")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(
            revisit,
            F.concat(
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"),
                line("WARC-Refers-To", F.col("first.record_id")),
                line("WARC-Refers-To-Target-URI", F.col("first.url")),
                line("WARC-Refers-To-Date", F.col("first.date")),
                line("WARC-Refers-To-Page-Key", F.col("first.page_key")),
            ),
        ).otherwise(line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.col("block_digest")))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.length(block).cast("string")),
        F.lit("\r\n"),
    )
    return marked.select(F.concat(F.encode(head, "UTF-8"), block).alias("record"))


def write_warc(records: DataFrame, path: str, images_per_file: int = IMAGES_PER_FILE) -> None:
    """WARC files of ``record_text`` rows, a gzip member a record; Spark names the files ``part-*``."""

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for record in batch.column(0):
                held.append(gzip.compress(record.as_py() + END, 6, mtime=0))
                size += len(held[-1])
                if size >= IMAGE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["image"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["image"])

    made = records.mapInArrow(images, "image binary").select(F.col("image").cast("string"))
    made.write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).option("maxRecordsPerFile", images_per_file).text(path)


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of every record of an uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        length = int(head["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("WARC record shorter than declared")
        yield head, block


READ = "page_key string, record_id string, record_type string, url string, date string, payload_bytes bigint, payload_digest string, refers_to_key string, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all WARC files under ``path``; digests of responses are checked."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_key", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_key", pa.string()), ("payload", pa.binary())])

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_py())) as unzipped, io.BufferedReader(unzipped, 1 << 20) as stream:
                    for h, block in parse_warc(stream):
                        top, _, payload = block.partition(b"\r\n\r\n")
                        own = h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-type"] == "response" and digest(payload) != own:
                            raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
                        length = next(int(x[16:]) for x in top.split(b"\r\n") if x.startswith(b"Content-Length: "))
                        rows.append((h["warc-page-key"], h["warc-record-id"], h["warc-type"], h["warc-target-uri"], h["warc-date"], length, own, h.get("warc-refers-to-page-key"), payload if payloads else None))
                        size += len(payload) if payloads else 200
                        if size > IMAGE_BYTES:
                            yield made(rows)
                            rows, size = [], 0
                if rows:
                    yield made(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(parsed, READ)


def archive_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """ARC, converted to WARC files in the shared folder, read back: a row a page."""
    spark = pages.sparkSession
    store.small_batches(spark)
    kind = dict(pages.dtypes)[key]
    records = convert(pages_to_arc(pages, key, url, payload))
    path = store.new_path(spark, "warc")
    write_warc(record_text(mark_revisits(records, min_bytes)), path)
    back = read_warc(spark, path)
    as_key = lambda c: F.when(F.col(c) != "-", F.col(c)).cast(kind)
    return back.select(as_key("page_key").alias(key), "payload_bytes", "payload_digest", "record_type", as_key("refers_to_key").alias("refers_to"))


def oracle(min_bytes: int = 0) -> str:
    """The same rows in SQL; base32 is spelled from 20-bit groups of the hex digest."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    group = "CAST('0x' || upper(substr(hex, 5 * i + 1, 5)) AS BIGINT)"
    four = " || ".join(f"substr('{letters}', CAST(({group} >> {s}) & 31 AS INTEGER) + 1, 1)" for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda i: {four}), '') AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= {min_bytes} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)"""
