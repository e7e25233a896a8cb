"""WARC archives: a writer, and a splittable reader that owns the records which begin in its byte range.

Writer. Records are gzip members, one each, as the format asks. Spark's text sink writes them, so any Hadoop
file system will do: it writes a string's bytes as they are and ends each with the separator, here a zero byte, which
is how a gzip member ends whose content is shorter than 16 MiB (the highest byte of its length). The member's last byte is left to
the separator; a longer record is followed by an empty member, which ends so too. Files are plain, standard archives, each with a warcinfo record.

Reader. Files are cut into byte ranges; a task scans its range for the gzip magic, takes a place for a member's start
only if what it decodes to begins with a WARC version line, and owns each record that begins inside its range,
reading beyond the end for the last one. Ranges are read by seeking, with pyarrow's file systems (local, HDFS, S3, GCS).

Payloads that are equal and of at least ``MIN_REVISIT`` bytes are stored once: the page with the largest id is the
response, the others are revisits that refer to it. Groups of copies are found by an aggregate of digests (partial on each
task), of which only those with several pages are joined back.

Edge cases. Null payload: empty, a response. Null id: written with an empty id, read back as null, never a group's
response unless all of its ids are null. Repeated rows: a record each; a repeated largest id is a response each time.
Very long payloads: one record, whole. No rows: no archive, no rows. Extra columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.blocks import _CLEANUP, filesystem, scratch

MIN_REVISIT = 1000
#: Bytes of a range that one task reads.
RANGE_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
_PROBE, _STEP = 512, 1 << 14

_RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, file string, position long"


def _member(head: list[tuple[str, str]], body: bytes) -> bytes:
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + f"Content-Length: {len(body)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = packer.compress(lines.encode() + body + b"\r\n\r\n") + packer.flush()
    if data[-1]:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        data += packer.compress(b"") + packer.flush()
    return data


def _record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    target = " ".join((url or "").split()) or "about:blank"
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    return _member([*head, ("Content-Type", "application/http; msgtype=response")], http + (b"" if revisit else payload))


def write_warc(pages: DataFrame, path: str, key: str = "page_id", payload: str = "html", url: str = "url", min_revisit: int = MIN_REVISIT) -> None:
    """Writes an archive for each partition of ``pages`` into the folder ``path``."""
    body = F.encode(F.coalesce(payload, F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    groups = rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(groups, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.select("page_id", "url", "payload", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:page:info>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"software: tessera\r\n")
        for batch in batches:
            out = [] if info is None else [info[:-1]]
            info = None
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "revisit"))
            out += [_record(*r)[:-1] for r in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    spark = pages.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        members = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
        members.write.mode("overwrite").option("lineSep", "\0").option("compression", "none").text(path)
    finally:
        spark.conf.set(_CLEANUP, before)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def _decoded(file, start: int, window: bytes, at: int) -> tuple[bytes, int] | None:
    """Content of the member at ``at`` of a window that begins at ``start``, and where it ends; None if it is none."""
    if not zlib_head(window[at : at + _PROBE] if len(window) - at >= _PROBE else _read(file, start + at, _PROBE)):
        return None
    unpack, out, place = zlib.decompressobj(31), [], at
    try:
        while True:
            data = window[place : place + _STEP] or _read(file, start + place, _STEP)
            if not data:
                return None
            out.append(unpack.decompress(data))
            place += len(data) - len(unpack.unused_data)
            if unpack.eof:
                return b"".join(out), start + place
    except zlib.error:
        return None


def _read(file, at: int, n: int) -> bytes:
    file.seek(at)
    return file.read(n)


def zlib_head(data: bytes) -> bool:
    """Whether a gzip member begins here that holds a WARC record."""
    try:
        return zlib.decompressobj(31).decompress(data, 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def records_in(file, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position, headers, block) of the records that begin in [start, end)."""
    window = _read(file, start, end - start + len(MAGIC) - 1)
    at = 0
    while (at := window.find(MAGIC, at)) >= 0 and start + at < end:
        got = _decoded(file, start, window, at)
        if got is None:
            at += 1
            continue
        content, after = got
        head, _, rest = content.partition(b"\r\n\r\n")
        fields = dict(line.partition(": ")[::2] for line in head.decode().split("\r\n")[1:])
        yield start + at, fields, rest[: int(fields["Content-Length"])]
        at = after - start


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """All response and revisit records of the archives in ``path``; revisits have no payload."""
    fs, folder = filesystem(spark, path)
    files = [(f.getPath().toString(), f.getLen()) for f in fs.listStatus(folder) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    ranges = [(name, at, min(at + range_bytes, size)) for name, size in files for at in range(0, size, range_bytes)]
    spans = spark.createDataFrame(ranges, "file string, start long, stop long")
    spans = spans.repartition(max(1, len(ranges)))

    def number(name: str) -> int | None:
        digits = name.removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("position", pa.int64())])
        for batch in batches:
            for span in batch.to_pylist():
                store, name = _filesystem(span["file"])
                with store.open_input_file(name) as file:
                    out, held = [], 0
                    for at, head, block in records_in(file, span["start"], span["stop"]):
                        if head["WARC-Type"] not in ("response", "revisit"):
                            continue
                        body = block.partition(b"\r\n\r\n")[2] if head["WARC-Type"] == "response" else None
                        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if body is not None and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"{span['file']}: damaged record at {at}")
                        refers = number(head["WARC-Refers-To"]) if body is None else None
                        out.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], refers, digest, int(head["X-Payload-Length"]), body if with_payload else None, span["file"], at))
                        held += len(body or b"")
                        if held >= 1 << 22 or len(out) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                            out, held = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return spans.mapInArrow(run, _RECORDS)


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op5_warc_round_trip": op5_warc_round_trip}
ORACLES = {
    "op5_warc_round_trip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
     g AS (SELECT payload_digest, max(page_id) AS first_id FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN g.first_id IS NULL OR g.first_id = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.first_id <> d.page_id THEN g.first_id END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)
""",
}
