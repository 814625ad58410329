"""Legacy archives: write and parse ARC files (versions 1 and 2), convert them to WARC, read WARC back.

Archive files are written by Spark's text writer (one gzip file per task, record bytes kept as they are) and read by its
binary-file reader, so any storage that Spark reaches will do. An archive is as large as one input split
makes it; readers unpack it as a stream.

ARC record: a header line, the declared number of bytes, a line end. Version 1 lines hold
``URL IP date type length``, version 2 lines ``URL IP date type status checksum location offset file length``; the first
record of a file declares the version. A line that does not parse, or a length beyond the file, ends that
file with one row whose ``error`` says so.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.session import fresh_path

# fixed values of the formats
FIELDS = {1: ("url", "ip", "date", "mime", "length"),
          2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "file", "length")}
DATE = re.compile(r"\d{14}")
LEAST_REVISIT = 100  # bytes from which equal payloads are revisits
BATCH_BYTES = 4 << 20

RECORD = pa.schema([("file", pa.string()), ("key", pa.string()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()),
                    ("status", pa.string()), ("http", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("error", pa.string())])
RECORD_DDL = ("file string, key string, url string, ip string, date string, mime string, status string, http binary, payload binary, "
              "payload_bytes long, payload_digest string, error string")


def batches_of(rows: Iterator[dict], schema: pa.Schema, sizes: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about BATCH_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(row[c] or b"") for c in sizes)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def write_archive(records: DataFrame, path: str) -> None:
    """Column ``value`` (binary, without its last line end) as gzip files, a file per task."""
    records.select(F.col("value").cast("string").alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(path)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
              date: str = "20080102030405", ip: str = "192.0.2.1") -> None:
    """Pages as ARC files; even tasks write version 1, odd tasks version 2.

    The id travels in the HTTP block as ``X-Record-Key``. Null bodies are empty payloads; a null or empty URL is ``-``; white space
    and control characters of a URL are percent-coded. A null id is the empty key.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        number = task.partitionId() if task else 0
        version = 1 + number % 2
        name = f"legacy-{number:06d}.arc"

        def line(url: str, kind: str, length: int, status: str = "200", offset: int = 0) -> bytes:
            have = {"url": url, "ip": ip, "date": date, "mime": kind, "length": length, "status": status, "checksum": "-", "location": "-", "offset": offset, "file": name}
            return " ".join(str(have[f]) for f in FIELDS[version]).encode() + b"\n"

        def rows() -> Iterator[dict]:
            names = {"url": "URL", "ip": "IP-address", "date": "Archive-date", "mime": "Content-type", "length": "Archive-length", "status": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "file": "Filename"}
            about = f"{version} 0 plumbline\n".encode() + " ".join(names[f] for f in FIELDS[version]).encode() + b"\n"
            first = line(f"filedesc://{name}", "text/plain", len(about)) + about
            yield {"value": first}
            offset = len(first) + 1
            for batch in batches:
                for key, url, body in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    data = (body or "").encode("utf-8", "surrogatepass")
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Record-Key: {key or ''}\r\nContent-Length: {len(data)}\r\n\r\n".encode()
                    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "-"
                    value = line(safe, "text/html", len(http) + len(data), offset=offset) + http + data
                    offset += len(value) + 1
                    yield {"value": value}

        yield from batches_of(rows(), pa.schema([("value", pa.binary())]), ("value",))

    rows = pages.select(F.col(id_col).cast("string").alias("key"), F.col(url_col).cast("string").alias("url"), F.col(body_col).cast("string").alias("body"))
    write_archive(rows.mapInArrow(run, "value binary"), path)


def arc_records(stream: io.BufferedIOBase, file: str) -> Iterator[dict]:
    """The records of one unpacked ARC file, after its version block."""
    blank = dict.fromkeys(RECORD.names)

    def bad(why: str) -> dict:
        return blank | {"file": file, "error": why}

    version = None
    while True:
        try:
            head = stream.readline()
            while head == b"\n":
                head = stream.readline()
            if not head:
                if version is None:
                    yield bad("empty archive")
                return
            words = head.decode("utf-8", "replace").rstrip("\r\n").split(" ")
            if version is None:
                if not head.startswith(b"filedesc://") or not words[-1].isdigit():
                    yield bad("no version block")
                    return
                about = stream.read(int(words[-1]))
                declared = about.split(b" ", 1)[0]
                if declared not in (b"1", b"2"):
                    yield bad("unknown version")
                    return
                version = int(declared)
                continue
            if len(words) != len(FIELDS[version]) or not words[-1].isdigit():
                yield bad("header line does not fit the version")
                return
            have = dict(zip(FIELDS[version], words))
            block = stream.read(int(have["length"]))
        except (OSError, EOFError) as error:
            yield bad(f"cannot unpack: {error}")
            return
        if len(block) < int(have["length"]):
            yield bad("declared length goes beyond the file")
            return
        http, cut, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
        key = re.search(rb"(?im)^X-Record-Key: *([^\r\n]*)", http)
        status = re.match(rb"HTTP/\S+ (\d+)", http)
        yield blank | {
            "file": file, "key": key[1].decode() if key else None, "url": have["url"], "ip": have["ip"], "date": have["date"], "mime": have["mime"],
            "status": have.get("status") or (status[1].decode() if status else None), "http": http + cut, "payload": payload, "payload_bytes": len(payload),
            "payload_digest": hashlib.sha256(payload).hexdigest()}


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, io.BufferedIOBase]]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = content.as_buffer()
            raw = pa.BufferReader(data)
            packed = bytes(data[:2]) == b"\x1f\x8b"
            yield path.rpartition("/")[2], io.BufferedReader(gzip.GzipFile(fileobj=raw)) if packed else io.BufferedReader(raw)


def read_arc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all ARC files below ``path``; ``payload=False`` leaves payload and HTTP block null but keeps size and digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for file, stream in unpacked(batches):
                for row in arc_records(stream, file):
                    yield row if payload else row | {"payload": None, "http": None}

        yield from batches_of(rows(), RECORD, ("payload", "http"))

    return files(spark, path).mapInArrow(run, RECORD_DDL)


def revisits(records: DataFrame, order: Column, least_bytes: int = LEAST_REVISIT) -> DataFrame:
    """``key, payload_digest, refers_to`` of the records whose payload an earlier record (by ``order``, then key) already has.

    One row per digest is kept before the shuffle; a digest shared by a third of all records meets it in a join
    whose large side adaptive execution splits.
    """
    rows = records.filter(F.col("error").isNull() & (F.col("payload_bytes") >= least_bytes)).select("key", "payload_digest", order.alias("rank"))
    first = rows.groupBy("payload_digest").agg(F.min(F.struct("rank", "key")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return (rows.join(first.select("payload_digest", F.col("first.key").alias("refers_to")), "payload_digest")
            .filter("key <> refers_to").select("key", "payload_digest", "refers_to").distinct())


def record_id(*what: str) -> str:
    """A WARC identifier that depends on the record alone, so that reruns write the same one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(what))}>"


def warc_date(date: str) -> str:
    """``yyyymmddhhmmss`` as ISO time; an impossible date is the epoch."""
    try:
        return datetime.strptime(date, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ") if DATE.fullmatch(date) else "1970-01-01T00:00:00Z"
    except ValueError:
        return "1970-01-01T00:00:00Z"


def write_warc(records: DataFrame, path: str) -> None:
    """Records with ``refers_to`` (null: response) as WARC 1.1 files; a revisit holds headers, digest and length but no payload."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for r in batch.to_pylist():
                    again = r["refers_to"] is not None
                    body = (r["http"] or b"") + (b"" if again else r["payload"] or b"")
                    head = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {record_id('record', r['key'] or '', r['url'], r['date'])}",
                            f"WARC-Date: {warc_date(r['date'])}", f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}",
                            f"WARC-Payload-Digest: sha256:{r['payload_digest']}", f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}",
                            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
                            f"X-Record-Key: {r['key'] or ''}", f"X-Payload-Length: {r['payload_bytes']}"]
                    if again:
                        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Key: {r['refers_to']}"]
                    yield {"value": "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r"}

        yield from batches_of(rows(), pa.schema([("value", pa.binary())]), ("value",))

    write_archive(records.select("key", "url", "ip", "date", "http", "payload", "payload_bytes", "payload_digest", "refers_to").mapInArrow(run, "value binary"), path)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = LEAST_REVISIT) -> None:
    """ARC files to WARC files with equal payloads as revisits of the record with the smallest numeric key.

    The archives are parsed twice: for digests alone, and to write. Bad records have an error row in :func:`read_arc` and no WARC record.
    """
    number = F.coalesce(F.col("key").try_cast("long"), F.lit(0))
    again = revisits(read_arc(spark, arc_path, payload=False), number, least_bytes)
    records = read_arc(spark, arc_path).filter(F.col("error").isNull())
    write_warc(records.join(again, ["key", "payload_digest"], "left"), warc_path)


WARC = pa.schema([("file", pa.string()), ("key", pa.string()), ("url", pa.string()), ("date", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()),
                  ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("error", pa.string())])
WARC_DDL = "file string, key string, url string, date string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, error string"


def warc_records(stream: io.BufferedIOBase, file: str) -> Iterator[dict]:
    """The records of one WARC file; a response's digest is computed from its payload and held against its header."""
    blank = dict.fromkeys(WARC.names)
    while True:
        try:
            line = stream.readline()
            while line in (b"\r\n", b"\n"):
                line = stream.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                yield blank | {"file": file, "error": "no record here"}
                return
            head = {}
            while (line := stream.readline().rstrip(b"\r\n")):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head[name.lower()] = value.strip()
            length = head.get("content-length", "")
            body = stream.read(int(length)) if length.isdigit() else b""
        except (OSError, EOFError) as error:
            yield blank | {"file": file, "error": f"cannot unpack: {error}"}
            return
        if not length.isdigit() or len(body) < int(length):
            yield blank | {"file": file, "error": "declared length is missing or goes beyond the file"}
            return
        again = head.get("warc-type") == "revisit"
        payload = body.partition(b"\r\n\r\n")[2] if body.startswith(b"HTTP/") else body
        said = head.get("warc-payload-digest", "").removeprefix("sha256:")
        found = said if again else hashlib.sha256(payload).hexdigest()
        yield blank | {
            "file": file, "key": head.get("x-record-key"), "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "record_id": head.get("warc-record-id"),
            "record_type": head.get("warc-type"), "payload_bytes": int(head.get("x-payload-length") or 0) if again else len(payload), "payload_digest": found,
            "refers_to": head.get("x-refers-to-key"), "error": None if found == said else "payload digest differs"}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all WARC files below ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of((row for file, stream in unpacked(batches) for row in warc_records(stream, file)), WARC, ())

    return files(spark, path).mapInArrow(run, WARC_DDL)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Pages through ARC files, the converter and WARC files: the records read back.

    Empty input gives no records. Rows with one id twice give a record each; where
    their payloads are equal as well, both are responses.
    """
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc, id_col, url_col, body_col)
    convert(spark, arc, warc)
    return read_warc(spark, warc)
