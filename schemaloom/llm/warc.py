"""WARC archives with resolved revisits.

Only headers (id, digest, size) are shuffled by payload digest; the smallest
page id of each digest is found with partial aggregation, so a payload that a
third of all pages share costs one row per task. Revisit records are joined
to their originals, and payloads are shuffled once, by page id, to the
writers. Each writer task streams gzip members to files of bounded size; the
list of files that the committed tasks wrote is a small table, so retried
attempts leave no double records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import chunks, open_folder, saved

MIN_REVISIT = 100
FILE_BYTES = 256 << 20
SLICE = 2 << 20  # bytes of payload that a task holds as Python objects
#: Date of the fresh headers, profile of identical payloads.
WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest of every page (null: empty)."""
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"),
                        F.octet_length(body).cast("long").alias("payload_bytes"),
                        F.sha2(body, 256).alias("payload_digest"))


def resolve(heads: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Adds record_type, refers_to, refers_url.

    Of equal payloads of ``min_bytes`` or more the smallest page_id is the
    response (rows that repeat this id are responses too); others revisit it.
    A null page_id never is an original: it revisits, or is a response if no
    page with an id has this payload.
    """
    first = saved(heads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
             .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("n"))
             .where((F.col("n") > 1) & F.col("first").isNotNull())
             .select("payload_digest", F.col("first.page_id").alias("_id"),
                     F.col("first.url").alias("_url")), "warc_first")  # plain join sides: AQE can split a hot digest
    again = F.col("_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_id"))
    return (heads.join(first, "payload_digest", "left")
            .select("page_id", "url", "payload_bytes", "payload_digest",
                    F.when(again, "revisit").otherwise("response").alias("record_type"),
                    F.when(again, F.col("_id")).alias("refers_to"),
                    F.when(again, F.col("_url")).alias("refers_url")))


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id} {digest}'.encode()).hexdigest())}>"


def _line(value: str) -> str:
    return " ".join(value.split())


def record(row: dict, payload: bytes) -> bytes:
    """One WARC record; a revisit has the HTTP head only."""
    again = row["record_type"] == "revisit"
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {row['payload_bytes']}\r\n\r\n").encode()
    block = http if again else http + payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}",
            f"WARC-Record-ID: {_record_id(row['page_id'], row['payload_digest'])}",
            f"WARC-Date: {WARC_DATE}", f"WARC-Target-URI: {_line(row['url'])}",
            f"WARC-Payload-Digest: sha256:{row['payload_digest']}"]
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if again:
        head += [f"WARC-Profile: {PROFILE}",
                 f"WARC-Refers-To: {_record_id(row['refers_to'], row['payload_digest'])}",
                 f"WARC-Refers-To-Target-URI: {_line(row['refers_url'])}",
                 f"WARC-Refers-To-Date: {WARC_DATE}", f"X-Refers-To-Page-ID: {row['refers_to']}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(root: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, folder = open_folder(root)
        out = name = None
        records = size = part = 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict(
                {"path": pa.array([name], pa.string()), "records": pa.array([records], pa.int64())})
        for batch in chunks(batches, "html", SLICE):
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{part}.warc.gz"
                    out = files.open_output_stream(f"{folder}/{name}", compression=None)
                member = gzip.compress(record(row, (row["html"] or "").encode()), 3, mtime=0)
                out.write(member)
                size += len(member)
                records += 1
                if size >= file_bytes:
                    yield closed()
                    out, records, size, part = None, 0, 0, part + 1
        if out is not None:
            yield closed()
    return write


def write_archives(pages: DataFrame, root: str, partitions: int | None = None,
                   min_bytes: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages as gzip WARC files below ``root`` (a URI that pyarrow
    can open on every executor). Returns the manifest: path, records."""
    spark = pages.sparkSession
    open_folder(root, create=True)
    heads = headers(pages)
    kinds = saved(resolve(heads, min_bytes), "warc_kinds")
    # Repeated ids: the payload's digest pairs a page with its own decision.
    body = pages.select("page_id", "html", F.sha2(F.encode(F.coalesce(F.col("html"), F.lit("")),
                                                           "UTF-8"), 256).alias("payload_digest"),
                        F.coalesce(F.col("url"), F.lit("")).alias("url"))
    one = kinds.dropDuplicates(["page_id", "payload_digest", "url"])
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = (body.alias("b").join(
        one.alias("k"), F.col("b.page_id").eqNullSafe(F.col("k.page_id"))
        & (F.col("b.payload_digest") == F.col("k.payload_digest"))
        & (F.col("b.url") == F.col("k.url")), "left")
        .select("b.page_id", "b.url", "k.payload_bytes", "b.payload_digest", "k.record_type",
                "k.refers_to", "k.refers_url",
                F.when(F.col("k.record_type") == "response", F.col("b.html")).alias("html")))
    return saved(full.mapInArrow(_writer(root, file_bytes), "path string, records long"),
                 "warc_manifest")


def parse(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of every record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        head: dict[str, str] = {"version": line.strip().decode()}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.decode().partition(":")
            head[key.strip().lower()] = value.strip()
        yield head, stream.read(int(head["content-length"]))


def read_archives(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, html (null in revisits).

    Size and digest of a response are taken anew from its payload; those of a
    revisit from its headers. Each task streams its files record by record.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("html", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = open_folder(root)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                rows, held = [], 0
                with files.open_input_stream(f"{folder}/{name}", compression=None) as raw, \
                        gzip.open(io.BufferedReader(raw), "rb") as stream:
                    for head, block in parse(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        again = head["warc-type"] == "revisit"
                        said = dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])
                        size = int(said[b"Content-Length"]) if again else len(payload)
                        digest = (head["warc-payload-digest"].removeprefix("sha256:") if again
                                  else hashlib.sha256(payload).hexdigest())
                        ids = [head.get(k) for k in ("x-page-id", "x-refers-to-page-id")]
                        page_id, refers = (int(x) if x is not None else None for x in ids)
                        rows.append((page_id, head["warc-target-uri"], size, digest,
                                     head["warc-type"], refers,
                                     None if again else payload.decode()))
                        held += len(block)
                        if held > SLICE or len(rows) >= 2000:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)],
                                schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n).mapInArrow(
        read, "page_id long, url string, payload_bytes long, payload_digest string, "
              "record_type string, refers_to long, html string")


def archive(pages: DataFrame) -> DataFrame:
    """Write below the shared folder and read back."""
    spark = pages.sparkSession
    root = scratch_path(spark, "warc")
    manifest = write_archives(pages, root)
    return read_archives(spark, root, manifest)
