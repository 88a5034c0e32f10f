"""WARC archives: writing captures, reading records, assembling transactions.

A capture is a request, a response (or a revisit of an equal payload) and a
metadata record, tied by concurrent-to identifiers.  Tasks write archives straight
to the shared folder, whole files or none, and read them as streams.  Assembly joins
the records by those identifiers into one nested row per capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import checkpoint, filesystem, make_folder, put_file, shared_path, small_side

#: Payloads below this many bytes are always stored in full.
LEAST_REVISIT = 1000
#: Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
MANIFEST = "archive string, records long"
RECORDS = (
    "archive string, type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, "
    "fields map<string,string>, payload_bytes long, payload_digest string, payload binary"
)


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of ``pages`` (page_id, url, html).

    Of payloads that are equal and not small, the one with the largest page_id is kept in full and the others refer to it.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    large = p.filter(F.octet_length("payload") >= LEAST_REVISIT)
    owners = large.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).filter("n > 1 AND owner IS NOT NULL").drop("n")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner"))
    return p.join(small_side(owners), "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _record_id(page_id: int | None, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=xxhash.xxh3_128_digest(f'{page_id}/{digest}/{kind}'.encode()))}>"


def _record(kind: str, record_id: str, uri: str, date: str, block: bytes, content_type: str, more: dict[str, str]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Target-URI": uri, "WARC-Date": date, **more, "Content-Type": content_type, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def _capture(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> list[bytes]:
    uri = _one_line(url)
    main, mark = _record_id(page_id, digest, "main"), "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    more = {"WARC-Payload-Digest": mark}
    if refers_to is None:
        kind, block = "response", http + payload
    else:
        kind, block = "revisit", http
        more |= {"WARC-Refers-To": _record_id(refers_to, digest, "main"), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    path = uri.split("://", 1)[-1]
    host, _, rest = path.partition("/")
    request = f"GET /{rest} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    fields = "" if page_id is None else f"page-id: {page_id}\r\n"
    if refers_to is not None:
        fields += f"refers-to-page: {refers_to}\r\n"
    tie = {"WARC-Concurrent-To": main}
    return [
        _record("request", _record_id(page_id, digest, "request"), uri, date, request, "application/http; msgtype=request", tie),
        _record(kind, main, uri, date, block, "application/http; msgtype=response", more),
        _record("metadata", _record_id(page_id, digest, "metadata"), uri, date, fields.encode(), "application/warc-fields", tie),
    ]


def _writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), []
        members: list[bytes] = []
        size = records = 0

        def close() -> None:
            name = f"{folder}/part-{part:06d}-{len(done):04d}.warc.gz"
            put_file(name, members)
            done.append((name, records))

        for batch in batches:
            for row in batch.to_pylist():
                for record in _capture(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], date):
                    members.append(gzip.compress(record, 1, mtime=0))
                    size += len(record)
                    records += 1
                if size >= ARCHIVE_BYTES:
                    close()
                    members, size, records = [], 0, 0
        if members:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["archive", "records"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the captures of ``pages`` (page_id, url, html) and return the manifest (archive, records).

    Defined cases: null html is an empty payload; a null page_id is written without
    one; null urls are empty, white space in urls is joined to one space; rows equal in page_id and
    payload have the same identifiers; an empty table writes no archive; further columns are ignored.
    """
    spark = pages.sparkSession
    folder = make_folder(spark, folder or shared_path(spark, "warc"))
    return checkpoint(with_revisits(pages).mapInArrow(_writer(folder, date), MANIFEST))


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a decompressed archive stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a record: {line[:60]!r}")
            continue
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, stream.read(int(head.get("content-length", 0)))


def _row(archive: str, head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = head.get("warc-type")
    fields, payload, digest, size = None, None, None, None
    if kind == "metadata":
        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if x.strip())]
    elif kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    elif kind == "revisit" and head.get("warc-payload-digest", "").startswith("sha1:"):
        digest = base64.b32decode(head["warc-payload-digest"][5:]).hex()
    return (
        archive, kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri", ""), head.get("warc-date"),
        fields, size, digest, payload if with_payload else None,
    )


_TYPES = [pa.string()] * 7 + [pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]
_NAMES = ["archive", "type", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "fields", "payload_bytes", "payload_digest", "payload"]


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                fs, path = filesystem(archive)
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in parse_records(stream):
                        rows.append(_row(archive, head, block, with_payload))
                        size += len(block)
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


def read_records(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives that ``manifest`` (archive) names, one task an archive.

    Payload size and SHA-1 are always those of the whole payload.
    """
    n = max(1, manifest.count())
    return manifest.select("archive").repartition(n, "archive").mapInArrow(_reader(with_payload), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (record_id, target_uri, date, response, request, metadata).

    ``response`` holds type, payload size, digest, payload and refers_to; a revisit's
    size comes from the response it refers to.  Where several requests or metadata
    records name one response, the one with the smallest identifier is taken.

    Defined cases: a response without a partner has null there; requests and metadata
    without a response are left out, as are records without an identifier; a
    revisit whose response is missing has a null size; empty input gives an empty result.
    """
    main = records.filter(F.col("type").isin("response", "revisit") & F.col("record_id").isNotNull())

    def partner(kind: str, *columns: str) -> DataFrame:
        own = records.filter((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        first = own.groupBy("concurrent_to").agg(F.min_by(F.struct("record_id", *columns), "record_id").alias(kind))
        return first.select(F.col("concurrent_to").alias(f"of_{kind}"), kind)

    whole = records.filter("type = 'response'").groupBy(F.col("record_id").alias("whole_id")).agg(F.max("payload_bytes").alias("whole_bytes"))
    joined = (
        main.join(partner("request", "target_uri"), F.col("record_id") == F.col("of_request"), "left")
        .join(partner("metadata", "fields"), F.col("record_id") == F.col("of_metadata"), "left")
        .join(whole, F.col("refers_to") == F.col("whole_id"), "left")
    )
    size = F.coalesce("payload_bytes", "whole_bytes")
    response = F.struct("type", size.alias("payload_bytes"), "payload_digest", "payload", "refers_to")
    return joined.select("record_id", "target_uri", "date", response.alias("response"), "request", "metadata")
