"""WARC archives: written by Spark's text writer, read back by a reader that salvages what damage leaves.

Writing. Each row is a record: `response` with the payload behind an HTTP header, or `revisit`, which names by `WARC-Refers-To` the
response that has an equal payload. Of the rows with equal payloads of at least `least` bytes, the one with the largest id is the response; rows
that share this id are all responses. The roles come from one aggregate over digests; payloads of the rows that turn out as revisits of a hot
payload are not shuffled. Records are compressed one by one, and one task writes one archive. Spark puts a separator behind each row: a member
of no content between compressed records, which any gzip reader skips, and the two line ends that close a record between plain ones.

Reading. At each place of an archive a gzip member or a version line is due. A record passes if its member is whole and its checksum
right, its header has a type, an id and a length, the length ends at the two line ends, and the digest of the payload is the one it
names. After a failed check the reader goes on to the next place where the first bytes of a member, or a version line, begin a record
that passes. What lies between is a quarantined gap: a row with the reason and the byte range. So a damaged record costs itself, not
its archive. A payload that quotes a whole WARC record is skipped with its record, unless that record is damaged.

A null payload is an empty one. A null id leaves the record without a number; such rows are responses. Repeated rows are separate
records. An empty table has no archives and no records. Columns other than id, url and payload are not looked at, whatever their names.
An archive is read by one task, and Spark reads files below 2 GB, so `TARGET` bounds those written here.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm import common as C
from staylens.llm import hot
from staylens.session import checkpoint_dir, materialise

TARGET, LEAST = 32 << 20, 1000
MAGIC, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
END = b"\r\n\r\n"
# a gzip member without content: header, an empty deflate block, checksum and length zero
NOTHING = bytes.fromhex("1f8b08000000000000030300") + bytes(8)
PIECE = 1 << 20
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NUMBER = re.compile(r"<urn:x-page:(-?\d+)>")


def roles(pages: DataFrame, least: int = LEAST, id: str = "page_id", url: str = "url", payload: str = "html", target: int = TARGET) -> DataFrame:
    """Frame (id, url, payload, refers_to): the payload as bytes, null for a revisit, which has the id of its response."""
    raw = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    size = F.octet_length(raw)
    rows = pages.select(F.col(id).cast("bigint").alias("id"), F.col(url).cast("string").alias("url"), raw.alias("payload"), F.when((size >= least) & F.col(id).isNotNull(), F.sha2(raw, 256)).alias("key"))
    slim = materialise(rows.select("id", "key", F.octet_length("payload").alias("bytes")))
    copied = slim.where("key is not null").groupBy("key").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("__copies")).where("__copies > 1").select("key", "last")
    copied = materialise(copied)
    total = slim.agg(F.sum(F.col("bytes") + 512)).first()[0] or 0
    revisit = F.col("last").isNotNull() & (F.col("id") < F.col("last"))
    counts = slim.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("key").isNotNull() & (F.col("__n") > max(1, slim.count() // hot.MOST)))
    few = copied.join(F.broadcast(counts.select("key")), "key").select(F.col("key").alias("__hot"), F.col("last").alias("__last"))  # fewer than hot.MOST rows
    marked = rows.join(F.broadcast(few), F.col("key") == F.col("__hot"), "left")
    spread = F.concat(F.lit("r"), F.monotonically_increasing_id().cast("string"))
    known = F.col("__hot").isNotNull() & (F.col("id") < F.col("__last"))
    facts = F.struct(F.octet_length("payload").cast("bigint").alias("bytes"), F.sha1("payload").alias("sha1"))
    marked = marked.select("id", "url", facts.alias("facts"), F.when(~known | F.col("__hot").isNull(), F.col("payload")).alias("payload"), "__last", F.when(F.col("__hot").isNull() & F.col("key").isNotNull(), F.col("key")).otherwise(spread).alias("__key"))
    files = max(1, -(-total // target))
    lookup = copied.select(F.col("key").alias("__key"), "last").repartition(files, "__key")
    found = marked.repartition(files, "__key").join(lookup, "__key", "left").withColumn("last", F.coalesce("__last", "last"))
    return found.select("id", "url", F.when(~revisit, F.col("payload")).alias("payload"), F.when(revisit, F.col("last")).alias("refers_to"), "facts")


def header(lines: list[tuple[str, str | None]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in lines if v is not None)


def quoted(url: str | None) -> str | None:
    """A url without characters that would end its header line."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def page_urn(id: int | None) -> str:
    return f"<urn:x-page:{id}>" if id is not None else f"<urn:uuid:{uuid.UUID(int=0)}>"


def record(id: int | None, url: str | None, payload: bytes | None, refers_to: int | None, size: int, sha1: str) -> bytes:
    """A record without the two line ends behind it. `payload` is None for a revisit; size and digest are those of the full payload."""
    http = b"HTTP/1.1 200 OK\r\n" + header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))]) + b"\r\n"
    block = http + (payload or b"")
    named = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", page_urn(id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", quoted(url)),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("WARC-Profile", IDENTICAL if refers_to is not None else None),
        ("WARC-Refers-To", page_urn(refers_to) if refers_to is not None else None),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + header(named) + b"\r\n" + block


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(found: DataFrame, path: str, compress: bool = True) -> None:
    """Write the rows of `roles` as archives below `path`, one for each partition."""
    C.prepare(found)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id, url, payload, refers_to, facts in zip(*[c.to_pylist() for c in batch.columns]):
                data = record(id, url, payload, refers_to, facts["bytes"], facts["sha1"])
                out.append(member(data + END) if compress else data)
            yield pa.record_batch({"record": pa.array(out, pa.binary())})

    lines = found.mapInArrow(made, "record binary").select(F.col("record").cast("string").alias("value"))
    separator = NOTHING if compress else END
    lines.write.option("encoding", "ISO-8859-1").option("lineSep", separator.decode("latin-1")).text(path)


class Failed(ValueError):
    """A check that a record did not pass."""


def inflated(data: memoryview, at: int) -> tuple[bytes, int]:
    """Content of the gzip member at a place, and the place behind it."""
    unpacker, out = zlib.decompressobj(31), []
    while not unpacker.eof:
        if at >= len(data):
            raise Failed("member cut off")
        piece = data[at : at + PIECE]
        try:
            out.append(unpacker.decompress(piece))
        except zlib.error as e:
            raise Failed("member damaged") from e
        at += len(piece) - len(unpacker.unused_data)
    return b"".join(out), at


def parsed(data: bytes | memoryview, at: int) -> tuple[dict, int]:
    """The record whose version line is at a place, and the place behind its two line ends."""
    head = bytes(data[at : at + 65536])
    version = VERSION.match(head)
    stop = head.find(END)
    if not version or stop < 0:
        raise Failed("no version line" if not version else "header not closed")
    fields = {}
    for line in head[version.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Failed("header line damaged")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()) or "warc-type" not in fields or "warc-record-id" not in fields:
        raise Failed("header incomplete")
    begin, end = at + stop + 4, at + stop + 4 + int(size)
    if bytes(data[end : end + 4]) != END:
        raise Failed("length does not end the record")
    block = bytes(data[begin:end])
    named = fields.get("warc-block-digest")
    if named and named.startswith("sha1:") and named[5:] != hashlib.sha1(block).hexdigest():
        raise Failed("block digest differs")
    http, _, payload = block.partition(END) if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    digest = (fields.get("warc-payload-digest") or "").removeprefix("sha1:").lower() or None
    whole = fields["warc-type"] != "revisit"
    if whole and digest and digest != hashlib.sha1(payload).hexdigest():
        raise Failed("payload digest differs")
    return {
        "record_type": fields["warc-type"],
        "record_id": fields["warc-record-id"],
        "url": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"),
        "payload": payload if whole else None,
        "payload_bytes": len(payload) if whole else int(length[1]) if length else None,
        "payload_digest": digest or (hashlib.sha1(payload).hexdigest() if whole else None),
    }, end + 4


def salvaged(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(start, end, record) of the records of an archive in order, and (start, end, reason) of the gaps that hold none."""
    view, at, gap, reason = memoryview(data), 0, None, ""
    while at < len(data):
        try:
            if data[at : at + 3] == MAGIC:
                content, end = inflated(view, at)
                found, used = parsed(content, 0) if content else (None, 0)
                if used != len(content):
                    raise Failed("member goes on behind its record")
            else:
                found, end = parsed(view, at)
        except Failed as failed:
            if gap is None:
                gap, reason = at, str(failed)
            later = START.search(data, at + 1)
            at = later.start() if later else len(data)
            continue
        if found is None and gap is not None:  # an empty member does not prove that the place is right
            at = end
            continue
        if gap is not None:
            yield gap, at, reason
            gap = None
        if found is not None:
            yield at, end, found
        at = end
    if gap is not None:
        yield gap, len(data), reason


FOUND = "archive string, start bigint, end bigint, reason string, record_type string, record_id string, url string, refers_to string, payload binary, payload_bytes bigint, payload_digest string"
NAMES = ["record_type", "record_id", "url", "refers_to", "payload", "payload_bytes", "payload_digest"]
TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record, and one for each quarantined gap, which has a reason and no record type. Without `payloads` only their
    sizes and digests are passed on."""
    files = C.prepare(spark.read.format("binaryFile").load(path).select("path", "content"))

    def table(archive: str, rows: list) -> pa.RecordBatch:
        records = [r[2] if isinstance(r[2], dict) else {} for r in rows]
        columns = {
            "archive": pa.array([archive] * len(rows), pa.string()),
            "start": pa.array([r[0] for r in rows], pa.int64()),
            "end": pa.array([r[1] for r in rows], pa.int64()),
            "reason": pa.array([r[2] if isinstance(r[2], str) else None for r in rows], pa.string()),
        }
        for name, kind in zip(NAMES, TYPES):
            columns[name] = pa.array([r.get(name) if payloads or name != "payload" else None for r in records], kind)
        return pa.record_batch(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1)):
                held, size = [], 0
                for row in salvaged(content.as_py() or b""):
                    held.append(row)
                    size += len(row[2].get("payload") or b"") if isinstance(row[2], dict) and payloads else 0
                    if len(held) >= C.TEXTS_PER_BATCH or size > PIECE:
                        yield table(archive.as_py(), held)
                        held, size = [], 0
                if held:
                    yield table(archive.as_py(), held)
                C.trim()

    return files.mapInArrow(run, FOUND)


def archived(pages: DataFrame, path: str | None = None, compress: bool = True, **options) -> str:
    """Write a table of pages as archives and return their folder: `path`, or a new one in the checkpoint folder."""
    spark = pages.sparkSession
    path = path or f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(roles(pages, **options), path, compress)
    return path


def number(column: Column) -> Column:
    """The page id that a record id names, null if it names none."""
    return F.nullif(F.regexp_extract(column, NUMBER.pattern, 1), F.lit("")).cast("bigint")
