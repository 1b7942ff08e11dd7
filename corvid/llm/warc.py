"""Web archives: pages to WARC records and back, oversized payloads as chunk rows.

An archive is a folder of gzipped WARC/1.1 files that Spark writes and reads, in whatever store the folder is. A
payload beyond the chunk size becomes a segmented record: a first record and continuation records, each with the
identifier of the whole and a segment number. A chunk also ends inside every occurrence of a record's first words,
so that the separator between records never stands inside one and reading, which streams, is exact.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.shared import fresh_path

SEPARATOR, VERSION = "\r\n\r\n", "WARC/1.1\r\n"
#: Payload bytes of a chunk, and records of a file.
CHUNK, FILE_RECORDS = 1 << 20, 20_000
_BREAK = re.compile(rb"WARC/1\.1")
_SPACE = uuid.UUID("6f1d3c62-6a37-4f5e-9a0e-0d5c5f6a7b11")


def chunks(payload: memoryview, most: int):
    """(start, end) of the payload's chunks: at most `most` bytes, at UTF-8 bounds, none holding a record's first words."""
    start, size = 0, len(payload)
    breaks = [m.start() + 2 for m in _BREAK.finditer(payload)]
    for stop in [*breaks, size]:
        while start < stop:
            end = min(stop, start + most)
            while start + 1 < end < stop and payload[end] & 0xC0 == 0x80:
                end -= 1
            yield start, end
            start = end
    if not size:
        yield 0, 0


def _header(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_id(page, hex_digest: str, again: str = "") -> uuid.UUID:
    """The identifier of a page's record. again tells rows that repeat a page and payload apart; others have none."""
    return uuid.uuid5(_SPACE, f"{page} {hex_digest} {again}")


def _records(page, url, payload, again, kind, refers, ambiguous, hex_digest, date, most):
    """The records of one page as strings without their last separator. ambiguous: several records are of the page that
    this one refers to, so it names the page alone."""
    name = record_id(page, hex_digest, again)
    target = "" if ambiguous else f"WARC-Refers-To: <urn:uuid:{record_id(refers, hex_digest)}>\r\n"
    digest = base64.b32encode(bytes.fromhex(hex_digest)).decode()
    shared = (
        f"WARC-Date: {date}\r\nWARC-Target-URI: {_header(url)}\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
        f"X-Page-Id: {'' if page is None else page}\r\nX-Payload-Length: {len(payload)}\r\n"
    )
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n"
    if kind == "revisit":
        body = http[:-2]
        yield (
            f"{VERSION}WARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:{name}>\r\n{shared}"
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
            f"{target}X-Refers-To-Page: {refers}\r\n"
            f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n{body}"
        )
        return
    parts = list(chunks(payload, most))
    running = hashlib.sha1()
    for n, (start, end) in enumerate(parts, 1):
        running.update(payload[start:end])
        body = str(payload[start:end], "utf-8")
        length = end - start
        first = n == 1
        out = [f"{VERSION}WARC-Type: {'response' if first else 'continuation'}\r\n"]
        out.append(f"WARC-Record-ID: <urn:uuid:{name if first else uuid.uuid5(name, str(n))}>\r\n{shared}")
        out.append(f"X-Running-Digest: {running.hexdigest()}\r\n")
        if len(parts) > 1:
            out.append(f"WARC-Segment-Number: {n}\r\n" + ("" if first else f"WARC-Segment-Origin-ID: <urn:uuid:{name}>\r\n"))
            if n == len(parts):
                out.append(f"WARC-Segment-Total-Length: {len(payload) + len(http)}\r\n")
        if first:
            out.append("Content-Type: application/http; msgtype=response\r\n")
            body, length = http + body, length + len(http)
        out.append(f"Content-Length: {length}\r\n\r\n{body}")
        yield "".join(out)


def write_archive(pages: DataFrame, path: str, min_revisit: int = 1000, chunk_bytes: int = CHUNK, date: str = "1970-01-01T00:00:00Z") -> str:
    """Write a record per row of `pages` (page_id, url, html) under path; returns path.

    The payload is html in UTF-8 (null: empty; null url: empty). Of rows with equal payloads of min_revisit bytes or
    more, those with the largest page_id are responses and others revisit it; a null page_id is never the largest
    where another exists. Rows that repeat a page_id are records of their own; of those with equal payloads too, all are
    of one kind, and a revisit of such a page names the page but none of its records. Each file is one gzip stream.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload")).withColumn("sha", F.when(F.col("n") >= min_revisit, F.sha2("payload", 256)))
    latest = rows.filter(F.col("n") >= min_revisit).groupBy("sha").agg(F.max("page_id").alias("refers"), F.count(F.lit(1)).alias("copies"))
    latest = latest.filter(F.col("copies") > 1).select("sha", "refers")
    # What is to be known of rows that revisit or repeat others is found without payloads. These pass one join by page and
    # digest, in which each row learns it; no list of pages is small enough to send it to all tasks instead.
    rows = rows.withColumn("digest", F.sha1("payload"))
    again = rows.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("m"), F.first("sha").alias("sha"))
    told = again.join(latest, "sha", "left").withColumn("refers", F.when(~F.col("page_id").eqNullSafe(F.col("refers")), F.col("refers")))
    told = told.filter("refers IS NOT NULL OR m > 1").select("page_id", "digest", "sha", "refers", (F.col("m") > 1).alias("again"))
    many = told.filter("again").select(F.col("page_id").alias("refers"), "sha", F.lit(True).alias("ambiguous"))
    told = told.join(many, ["refers", "sha"], "left").select("page_id", "digest", "refers", "again", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))
    known = rows.alias("r").join(told.alias("v"), F.col("r.page_id").eqNullSafe(F.col("v.page_id")) & (F.col("r.digest") == F.col("v.digest")), "left").select(
        "r.page_id", "r.url", F.when(F.col("v.refers").isNull(), F.col("r.payload")).alias("payload"), "r.n", "r.digest", "v.refers",
        F.coalesce("v.again", F.lit(False)).alias("again"), F.coalesce("v.ambiguous", F.lit(False)).alias("ambiguous"),
    )

    def run(batches):
        ordinal = 0
        for batch in batches:
            out, held = [], 0
            for i in range(batch.num_rows):
                page, url, size, digest, refers, repeats, ambiguous = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4, 5, 6, 7))
                raw = batch.column(2)[i].as_buffer() if refers is None else None
                data = memoryview(raw) if raw is not None else _Length(size)
                ordinal += 1
                told_apart = f"{TaskContext.get().partitionId()}:{ordinal}" if repeats else ""
                for record in _records(page, url, data, told_apart, "revisit" if refers is not None else "response", refers, ambiguous, digest, date, chunk_bytes):
                    out.append(record)
                    held += len(record)
                    if held >= 8 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["record"])
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["record"])

    known.mapInArrow(run, "record string").write.options(lineSep=SEPARATOR, compression="gzip", maxRecordsPerFile=FILE_RECORDS).text(path)
    return path


class _Length:
    """Stands for a payload of which a revisit needs the length alone."""

    def __init__(self, size: int):
        self.size = size

    def __len__(self) -> int:
        return self.size


_FIELD = {
    name: re.compile(rb"\r\n" + name.encode() + rb":[ \t]*([^\r\n]*)", re.I)
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Segment-Origin-ID", "WARC-Segment-Number", "WARC-Segment-Total-Length", "WARC-Payload-Digest", "Content-Length", "X-Page-Id", "X-Payload-Length", "X-Refers-To-Page", "X-Running-Digest", "WARC-Target-URI")
}


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """The archives under path as rows of record_id and chunk_no, with headers and the chunk's payload bytes."""
    raw = spark.read.option("lineSep", SEPARATOR + VERSION).text(path).select(F.col("value").cast("binary").alias("value"))
    schema = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int64()), ("last", pa.bool_()), ("record_type", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("running", pa.string()), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column(0):
                piece = value.as_py().removeprefix(VERSION.encode())
                head, _, body = (b"\r\n" + piece).partition(b"\r\n\r\n")
                got = {k: m[1].decode() if (m := p.search(head)) else None for k, p in _FIELD.items()}
                body = body[: (length := int(got["Content-Length"]))]
                if len(body) != length:
                    raise ValueError(f"record {got['WARC-Record-ID']} is cut short")
                kind, number = got["WARC-Type"], int(got["WARC-Segment-Number"] or 1)
                if kind == "response":
                    body = body.partition(b"\r\n\r\n")[2]
                last = got["WARC-Segment-Number"] is None or got["WARC-Segment-Total-Length"] is not None
                digest = base64.b32decode(got["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                rows.append((got["WARC-Segment-Origin-ID"] or got["WARC-Record-ID"], number, last, kind, got["X-Page-Id"] or None, got["WARC-Target-URI"], got["X-Refers-To-Page"], int(got["X-Payload-Length"]), digest, got["X-Running-Digest"], b"" if kind == "revisit" else body))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)

    return raw.mapInArrow(run, "record_id string, chunk_no long, last boolean, record_type string, page_id string, url string, refers_to string, payload_bytes long, digest string, running string, payload binary")


def read_archive(spark: SparkSession, path: str, page_kind: str = "bigint") -> DataFrame:
    """Per record under path: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Digests of responses are computed again from their chunks and compared with the header. Whole records are settled
    where they are read; chunks of segmented ones are sorted by record and number and streamed, digest in hand, so no
    payload is ever held whole. A damaged record raises an error.
    """
    found = chunk_table(spark, path)
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"

    def settle(batches):
        now, number, digest, size = None, 0, None, 0
        for batch in batches:
            out = []
            for i, (record, n, last, kind, page, url, refers, length, wanted, running) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(10)))):
                if record != now or n == 1:
                    if now is not None and digest is not None:
                        raise ValueError(f"record {now} lacks its last chunk")
                    now, number, digest, size, first = record, 0, hashlib.sha1(), 0, (kind, page, url, refers)
                if n != number + 1:
                    raise ValueError(f"record {record} lacks chunk {number + 1}")
                number = n
                chunk = batch.column(10)[i].as_buffer()
                digest.update(chunk)
                size += len(chunk)
                if kind != "revisit" and digest.hexdigest() != running:
                    raise ValueError(f"chunk {n} of record {record} is damaged")
                if last:
                    if kind != "revisit" and (size != length or digest.hexdigest() != wanted):
                        raise ValueError(f"record {record} is damaged")
                    kind, page, url, refers = first
                    out.append((page, url, length, wanted, kind, refers))
                    digest = None
            types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, types)], names)
        if digest is not None:
            raise ValueError(f"record {now} lacks its last chunk")

    whole = (F.col("chunk_no") == 1) & F.col("last")
    one = found.filter(whole).mapInArrow(settle, schema)
    many = found.filter(~whole).repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(settle, schema)
    out = one.unionByName(many)
    return out.select(F.col("page_id").cast(page_kind).alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(page_kind).alias("refers_to"))


def archived(pages: DataFrame, path: str | None = None, min_revisit: int = 1000, chunk_bytes: int = CHUNK) -> DataFrame:
    """Write `pages` to an archive in the shared folder (or at path) and read it back; see write_archive, read_archive.

    An empty table gives an empty archive and an empty result; columns other than page_id, url and html are ignored.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    return read_archive(spark, write_archive(pages, path or fresh_path(spark, "warc"), min_revisit, chunk_bytes), kind)
