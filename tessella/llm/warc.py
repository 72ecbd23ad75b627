"""WARC archives: writing, reading, and assembling records into captures.

Each page becomes three records: its request, its response (or a revisit, if a page with a smaller id
has the same payload) and a metadata record; request and metadata name the response in
WARC-Concurrent-To.  Payloads are hashed in a first pass and only the hashes shuffle; a second pass
writes the responses where they are, and revisits need no payload.  The archives are written by Spark's
text writer with the record end as its line end, so they go to any file system that Spark writes to; a
file is one gzip member and holds about `FILE_BYTES` before compression, or one page if that is longer.

Reading takes each file as a stream, record by record, and yields one row per record.  Assembly groups
the records by the response or revisit that they are concurrent to, whichever of the two names the
other, and emits one row per capture with the three nested in it; of several requests or metadata
records of a capture, the one with the least record id.

Defined cases: a null html is an empty payload; a null url has no target URI; a null id is written as
no id and read back as null, and is larger than any other; an id is written percent-encoded, whatever is
in it; of identical rows (same id and payload) one is the response and the others revisit it; other
columns of the input are not used; an empty table gives an empty result.  The pages are read twice, so
they must be files or a table, with the same rows in the same partitions each time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from functools import partial
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.tables import cut, join_groups, shared_dir, without, written

CRLF = "\r\n"
END = CRLF + CRLF
#: Bytes of records in a file, before compression.
FILE_BYTES = 1 << 25
#: Bytes of records that a Python worker hands over at once.
PIECE = 1 << 22
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("9d1f6f0e-3f0a-4f5c-9a51-7c1b6b1f3a20")


def record_id(page: str | None, nth: int, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{kind}:{page}:{nth}')}>"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record(headers: list[tuple[str, str | None]], block: str) -> str:
    named = "".join(f"{k}: {v}{CRLF}" for k, v in headers if v is not None)
    return f"WARC/1.1{CRLF}{named}Content-Length: {len(block.encode())}{END}{block}"


def _uri(url: str | None) -> str | None:
    """The URL as a header's value: white space and control characters percent-encoded."""
    return None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def transaction(page: str | None, url: str | None, html: str | None, size: int, sha1: bytes, nth: int, first_page: str | None, first_nth: int | None) -> str:
    """The page's three records, with record ends between them: a revisit of the first page if there is one (html isn't needed then)."""
    own, uri, digest = record_id(page, nth, "response"), _uri(url), f"sha1:{base32(sha1)}"
    common = [("WARC-Target-URI", uri), ("WARC-Date", DATE)]
    rest = uri.partition("://")[2] if uri else ""
    host, slash, path = rest.partition("/")
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", record_id(page, nth, "request")), ("WARC-Concurrent-To", own), *common, ("Content-Type", "application/http; msgtype=request")],
        f"GET {slash + path or '/'} HTTP/1.1{CRLF}Host: {host}{END}",
    )
    head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {size}{END}"
    kept = [("WARC-Record-ID", own), ("WARC-Payload-Digest", digest), *common, ("Content-Type", "application/http; msgtype=response")]
    if first_nth is None:
        answer = _record([("WARC-Type", "response"), *kept], head + html)
    else:
        answer = _record([("WARC-Type", "revisit"), *kept, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first_page, first_nth, "response"))], head)
    fields = "" if page is None else f"pageId: {quote(page, safe='')}{CRLF}"
    fields += f"payloadLength: {size}{CRLF}"
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(page, nth, "metadata")), ("WARC-Concurrent-To", own), *common, ("Content-Type", "application/warc-fields")], fields)
    return END.join([request, answer, metadata])


def _records(batches: Iterator[pa.RecordBatch], file_bytes: int) -> Iterator[pa.RecordBatch]:
    """(value, file): transactions, and which of the task's files each goes to."""
    file = held = 0
    for batch in batches:
        made, files, size = [], [], 0
        for row in zip(*(batch.column(name) for name in ("id", "url", "html", "size", "sha1", "nth", "first_id", "first_nth")), strict=True):
            made.append(transaction(*(x.as_py() for x in row)))
            length = len(made[-1])
            if held and held + length > file_bytes:
                file, held = file + 1, 0
            files.append(file)
            held += length
            size += length
            if size > PIECE:
                yield _lines(made, files)
                made, files, size = [], [], 0
        yield _lines(made, files)


def _lines(made: list[str], files: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(made, pa.string()), pa.array(files, pa.int32())], names=["value", "file"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write the pages' records under path.  Of equal payloads of at least least_revisit bytes the page with the smallest id is the response."""
    html, nth = F.coalesce(pages[html_col], F.lit("")), F.monotonically_increasing_id().alias("nth")
    common = [pages[id_col].cast("string").alias("id"), pages[url_col].alias("url"), F.octet_length(html).cast("long").alias("size"), F.sha1(html.cast("binary")).alias("sha1"), nth]
    hashed = written(pages.select(pages[id_col].alias("order"), *common))
    large = hashed.where(F.col("size") >= least_revisit)
    key = F.struct(F.col("order").isNull().alias("last"), "order", "nth", "id")
    several = cut(large.groupBy("sha1").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1"))
    later = join_groups(large, several, "sha1", "n", hashed.count()).where(F.col("nth") != F.col("first.nth"))
    later = cut(later.select("id", "url", F.lit(None).cast("string").alias("html"), "size", "sha1", "nth", F.col("first.id").alias("first_id"), F.col("first.nth").alias("first_nth")))
    first = without(pages.select(*common, html.alias("html")), later.select("nth"))
    first = first.withColumns({"first_id": F.lit(None).cast("string"), "first_nth": F.lit(None).cast("long")}).select(later.columns)
    rows = first.unionByName(later).withColumn("sha1", F.unhex("sha1"))
    lines = rows.mapInArrow(partial(_records, file_bytes=file_bytes), "value string, file int")
    lines.write.partitionBy("file").option("lineSep", END).option("compression", "gzip").text(path)


def parse(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record."""
    end = END.encode()
    while version := archive.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record at {version[:40]!r}")
        headers = {}
        while (line := archive.readline()) not in (b"", CRLF.encode()):
            k, _, v = line.decode().rstrip(CRLF).partition(": ")
            headers[k.lower()] = v
        block = archive.read(int(headers["content-length"]))
        if archive.read(len(end)) != end:
            raise ValueError(f"no record end after {headers['warc-record-id']}")
        yield headers, block


_PARSED = pa.schema([("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
_SCHEMA = "record_id string, concurrent_to string, refers_to string, type string, target_uri string, digest string, payload_bytes long, fields map<string,string>, payload binary"


def _parse_files(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for headers, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())))):
                kind = headers["warc-type"]
                payload, digest, fields = b"", None, []
                if kind in ("response", "revisit", "request"):
                    payload = block.partition(END.encode())[2]
                elif headers.get("content-type") == "application/warc-fields":
                    fields = [tuple(line.split(": ", 1)) for line in block.decode().split(CRLF) if ": " in line]
                if kind == "response":
                    digest = base32(hashlib.sha1(payload).digest())
                    if headers.get("warc-payload-digest") not in (None, f"sha1:{digest}"):
                        raise ValueError(f"{headers['warc-record-id']} has another digest than its payload")
                elif kind == "revisit":
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                rows.append((headers["warc-record-id"], headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), kind, headers.get("warc-target-uri"), digest, len(payload), fields, payload if payloads else None))
                held += len(payload) + 1_000 if payloads else 1_000
                if held > 1 << 24:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_PARSED)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARSED, strict=True)], schema=_PARSED)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the gzipped archives under path; payload is null without payloads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(partial(_parse_files, payloads=payloads), _SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: record_id, type, response, request, metadata (structs; null where there is none).

    A request or metadata record belongs to the response or revisit that it is concurrent to, or that is concurrent to it.  records are read more than once: write them down first."""
    answers = F.col("type").isin("response", "revisit")
    own = F.when(answers, F.col("record_id")).otherwise(F.col("concurrent_to"))
    named = records.where(answers & F.col("concurrent_to").isNotNull()).select(F.col("record_id").alias("capture"), F.col("concurrent_to").alias("named"))
    back = records.where(~answers & F.col("concurrent_to").isNull()).join(named, F.col("record_id") == F.col("named")).drop("named")
    every = records.withColumn("capture", own).where("capture is not null").unionByName(back)
    answer = F.struct("type", F.struct("refers_to", "target_uri", "digest", "payload_bytes", "payload").alias("response"))
    parts = {"answer": (answers, answer)} | {kind: (F.col("type") == kind, F.struct("record_id", "target_uri", "fields")) for kind in ("request", "metadata")}
    grouped = every.groupBy("capture").agg(*[F.min_by(F.when(is_one, what), F.when(is_one, F.col("record_id"))).alias(name) for name, (is_one, what) in parts.items()])
    return grouped.where("answer is not null").select(F.col("capture").alias("record_id"), "answer.type", "answer.response", "request", "metadata")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of each page, read from archives written for it."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, url_col, html_col, file_bytes=file_bytes)
    captures = assemble(cut(read_archives(spark, path, payloads=False)))
    kind = pages.schema[id_col].dataType
    page, length = F.url_decode(F.col("metadata.fields")["pageId"]).cast(kind), F.col("metadata.fields")["payloadLength"].cast("long")
    captures = cut(captures.select("record_id", "type", page.alias("id"), "response.refers_to", "response.digest", F.when(F.col("type") == "response", F.col("response.payload_bytes")).otherwise(length).alias("payload_bytes")))
    revisits = captures.where("type = 'revisit'")
    targets = captures.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("id").alias("first"))
    targets = targets.join(revisits.groupBy("refers_to").agg(F.count("*").alias("n")), "refers_to")
    revisits = join_groups(revisits, targets, "refers_to", "n", captures.count())
    response = captures.where("type = 'response'").withColumns({"first": F.lit(None).cast(kind), "n": F.lit(None).cast("long")})
    return response.unionByName(revisits).select("id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("first").alias("refers_to"))
