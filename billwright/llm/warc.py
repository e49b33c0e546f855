"""WARC archives: write captures, read records, assemble transactions.

Each capture is written as three records of one gzip member each: a response (or a revisit,
if an equal payload is already archived under a smaller page id), the request and a metadata
record, the latter two naming the first in ``WARC-Concurrent-To``. Reading parses records
file by file as a stream; the assembly joins the three kinds through those identifiers and
emits one nested row per capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billwright.session import shared_folder, stored

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file is closed once it holds so many compressed bytes; a capture is never split.
FILE_BYTES = 32 << 20

CAPTURE_SCHEMA = (
    "page_id long, url string, payload binary, refers_to long, refers_to_url string"
)
FILE_SCHEMA = "path string, n_captures long, n_bytes long"
RECORD_SCHEMA = (
    "kind string, record_id string, concurrent_to string, target_uri string, date string, "
    "headers map<string,string>, fields map<string,string>, http_status int, "
    "payload_bytes long, payload_digest string, intact boolean, payload binary"
)


def digest_of(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


# ---- Writing -----------------------------------------------------------------------
def with_revisits(captures: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add ``refers_to`` and ``refers_to_url``: the capture that has this payload already.

    Of captures with equal payloads of ``least_bytes`` or more, that of the smallest page id
    is the response (rows that repeat that id are responses too); the others refer to it.
    Payloads are compared by SHA-1 and length. Only one row per task and payload is counted.
    """
    sized = captures.withColumns({"__sha": F.sha1("payload"), "__size": F.length("payload")})
    first = (
        sized.filter(F.col("__size") >= least_bytes)
        .groupBy("__sha", "__size")
        .agg(
            F.count("*").alias("__copies"),
            F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("__first"),
        )
        .filter("__copies > 1")
    )
    other = F.col("__first.page_id") != F.col("page_id")
    return (
        sized.join(first, ["__sha", "__size"], "left")
        .withColumn("refers_to", F.when(other, F.col("__first.page_id")))
        .withColumn("refers_to_url", F.when(other, F.col("__first.url")))
        .drop("__sha", "__size", "__copies", "__first")
    )


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, b"WARC-Type: " + kind.encode()]
    lines += [f"{name}: {value}".encode() for name, value in headers]
    lines += [b"Content-Length: %d" % len(block), b"", block, b"", b""]
    return gzip.compress(b"\r\n".join(lines), compresslevel=6, mtime=0)


def _address(url: str | None) -> str:
    """A url as a header value: blanks and control characters are escaped; null is empty."""
    return quote(url or "", safe="".join(map(chr, range(0x21, 0x7F))))


def transaction(capture: dict, date: str) -> bytes:
    """The three records of one capture."""
    payload = capture["payload"] or b""
    own = f"<urn:uuid:{uuid.uuid4()}>"
    target, revisit = _address(capture["url"]), capture["refers_to"] is not None
    digest = f"sha1:{digest_of(payload)}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += b"Content-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Record-ID", own), ("WARC-Target-URI", target), ("WARC-Date", date)]
    head += [("WARC-Payload-Digest", digest)]
    if revisit:
        origin = _address(capture["refers_to_url"])
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Target-URI", origin)]
        head += [("WARC-Refers-To-Date", date)]
    head += [("Content-Type", "application/http; msgtype=response")]
    main = _record("revisit" if revisit else "response", head, http if revisit else http + payload)

    def beside(kind: str, content: str, block: bytes) -> bytes:
        names = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Target-URI", target)]
        names += [("WARC-Date", date), ("WARC-Concurrent-To", own), ("Content-Type", content)]
        return _record(kind, names, block)

    path = target.partition("://")[2].partition("/")[2]
    request = f"GET /{path} HTTP/1.1\r\nUser-Agent: crawler\r\n\r\n".encode()
    about = {"page-id": capture["page_id"], "refers-to-page": capture["refers_to"]}
    about["url-missing"] = "yes" if capture["url"] is None else None
    fields = "".join(f"{k}: {v}\r\n" for k, v in about.items() if v is not None)
    return (
        main
        + beside("request", "application/http; msgtype=request", request)
        + beside("metadata", "application/warc-fields", fields.encode())
    )


def write_archives(
    captures: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Write captures (``CAPTURE_SCHEMA``) to ``folder``; return the stored list of files.

    Every task attempt writes files of its own and only those of the attempts that ended
    well are listed, so a lost executor leaves no double captures. ``folder`` is one that
    all executors share, as an address that Arrow's file systems know.
    """

    names = list(captures.columns)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = arrow_fs.FileSystem.from_uri(folder)
        done, out, path, count, size = [], None, "", 0, 0

        def close():
            if out is not None:
                out.close()
                done.append((path, count, size))

        for batch in batches:
            columns = [batch.column(c) for c in names]
            for row in range(batch.num_rows):
                values = (c[row].as_py() for c in columns)
                data = transaction(dict(zip(names, values, strict=True)), date)
                if out is None or size >= FILE_BYTES:
                    close()
                    files.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, count, size = f"{folder}/{name}", 0, 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                count, size = count + 1, size + len(data)
        close()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([d[0] for d in done], pa.string()),
                pa.array([d[1] for d in done], pa.int64()),
                pa.array([d[2] for d in done], pa.int64()),
            ],
            names=["path", "n_captures", "n_bytes"],
        )

    return stored(captures.mapInArrow(write, FILE_SCHEMA), "warc-files")


# ---- Reading -----------------------------------------------------------------------
def parse_records(stream) -> Iterator[dict]:
    """Records of a decompressed archive, each with its headers and its block's bytes."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = _fields(stream)
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("the archive ends within a record")
        yield {"headers": headers, "block": block}


def _fields(stream) -> dict[str, str]:
    found: dict[str, str] = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _row(record: dict, payloads: bool) -> dict:
    headers, block = record["headers"], record["block"]
    kind = headers.get("warc-type", "")
    row = {name.split()[0]: None for name in RECORD_SCHEMA.split(", ")}
    row |= {
        "kind": kind,
        "record_id": headers.get("warc-record-id"),
        "concurrent_to": headers.get("warc-concurrent-to"),
        "target_uri": headers.get("warc-target-uri"),
        "date": headers.get("warc-date"),
        "headers": list(headers.items()),
    }
    if kind == "metadata":
        row["fields"] = list(_fields(io.BytesIO(block)).items())
    elif kind in ("response", "revisit"):
        stream = io.BytesIO(block)
        status = stream.readline().split()
        http = _fields(stream)
        row["fields"] = list(http.items())
        row["http_status"] = int(status[1]) if len(status) > 1 and status[1].isdigit() else None
        noted = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response":
            payload = stream.read()
            own = digest_of(payload)
            row |= {"payload_bytes": len(payload), "payload_digest": own, "intact": own == noted}
            row["payload"] = payload if payloads else None
        else:  # the payload is elsewhere: the stored headers describe it
            length = http.get("content-length", "")
            row["payload_bytes"] = int(length) if length.isdigit() else None
            row["payload_digest"] = noted
    return row


def read_records(files: DataFrame, payloads: bool = True) -> DataFrame:
    """All records (``RECORD_SCHEMA``) of the archives listed in ``files`` (path).

    Archives are streamed, so memory holds one record and one batch of rows. With
    ``payloads`` False, payloads are digested and measured but not returned.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(RECORD_SCHEMA))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files_of, inner = arrow_fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with (
                    files_of.open_input_stream(inner, compression=None) as raw,
                    gzip.GzipFile(fileobj=raw) as stream,
                ):
                    for record in parse_records(stream):
                        rows.append(_row(record, payloads))
                        held += 500 + (len(record["block"]) if payloads else 0)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    spark = files.sparkSession
    tasks = min(files.count(), 4 * spark.sparkContext.defaultParallelism)
    return files.select("path").repartition(max(1, tasks)).mapInArrow(read, RECORD_SCHEMA)


def assembled(records: DataFrame) -> DataFrame:
    """One nested row per capture: (page_id, capture_id, url, date, response, request, metadata).

    Requests and metadata find their response or revisit through ``concurrent_to``. A capture
    that lacks one of them has null there; records that name no capture are left aside. The
    records are stored by kind first, so that archives are read once.
    """
    spark = records.sparkSession
    folder = shared_folder(spark, "warc-records")
    records.write.partitionBy("kind").parquet(folder)
    kept = spark.read.schema(records.schema).parquet(folder)

    def beside(kind: str) -> DataFrame:
        return kept.filter(F.col("kind") == kind).select(
            F.col("concurrent_to").alias("capture_id"),
            F.struct("record_id", "date", "headers", "fields").alias(kind),
        )

    main = kept.filter(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"),
        F.col("target_uri").alias("url"),
        "date",
        F.struct(
            "kind", "headers", "http_status", "payload_bytes", "payload_digest", "intact", "payload"
        ).alias("response"),
    )
    joined = main.join(beside("request"), "capture_id", "left").join(
        beside("metadata"), "capture_id", "left"
    )
    fields = F.col("metadata.fields")
    return joined.select(
        fields["page-id"].try_cast("long").alias("page_id"),
        "capture_id",
        F.when(fields["url-missing"].isNull(), F.col("url")).alias("url"),
        "date",
        "response",
        "request",
        "metadata",
        fields["refers-to-page"].try_cast("long").alias("refers_to"),
    )


def round_trip(
    pages: DataFrame, least_bytes: int = 0, payloads: bool = True, folder: str | None = None
) -> DataFrame:
    """Archive ``pages`` (page_id, url, html), read the archives, assemble the captures.

    Null html is the empty payload, a null url an empty address; a null page id is written
    without id and comes back null. Repeated rows are captures of their own. Further
    columns don't matter. An empty table gives an empty result.
    """
    captures = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"),
    )
    folder = folder or shared_folder(pages.sparkSession, "warc")
    files = write_archives(with_revisits(captures, least_bytes), folder)
    return assembled(read_records(files, payloads))
