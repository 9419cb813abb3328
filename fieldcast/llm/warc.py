"""WARC archives: one gzip member per record, written and read by executors.

``write_warc`` finds equal payloads by digest with one small aggregation (payloads are never shuffled while the table of
repeated digests is small; its size is checked) and writes one file or more per task to a shared folder. Names hold the
task's attempt, and the returned table lists the files of the attempts that count; those of a lost executor are left aside.
``read_warc`` lists files with Spark's binaryFile source, takes those of that table and runs a sequential reader: incremental
zlib decompression in small chunks, framing by Content-Length, digest verification. Files are cut at ``file_bytes``, which
bounds a reader task's memory.

Defined cases: null html is an empty payload, null url an empty target; page ids must be integers; a null page_id is never the target of a revisit
unless all of its group are null; of tied payloads the smallest page_id is the response, and equal page_ids with equal
payloads are all responses; very long payloads are records of their own size; repeated rows are a record each; an empty table
gives no file and an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, saved

_URN = "urn:page:"
SMALL_GROUPS = 50_000  # of about 100 bytes: 5 MB


def _record(page_id, url: str, payload: bytes, digest: str, size: int, first) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.0",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{first}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_warc(pages: DataFrame, folder: str, smallest: int = 100, file_bytes: int = 16 << 20, level: int = 3) -> DataFrame:
    """Write all pages; the result (made when it is read, so store it) has each file's path, records and bytes."""
    root = pages.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root.getFileSystem(pages.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(root)
    html = F.coalesce("html", F.lit(""))
    d = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    groups = saved(d.filter(F.col("size") >= smallest).groupBy(F.col("digest").alias("_digest"), F.col("size").alias("_size")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    few = groups.limit(SMALL_GROUPS + 1).count() <= SMALL_GROUPS
    same = (F.col("digest") == F.col("_digest")) & (F.col("size") == F.col("_size"))
    d = d.join(F.broadcast(groups) if few else groups, same, "left").select(
        "page_id", "url", "html", "digest", "size", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))  # Spark's names of the scheme
        task, k, out, n, size, path = TaskContext.get(), 0, None, 0, 0, ""
        done = []

        def close() -> None:
            out.close()
            done.append((path, n, size))

        for b in batches:
            for page_id, url, x, digest, length, first in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    path, n, size = f"pages-{task.partitionId():05d}-{k:04d}-{task.taskAttemptId()}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{path}", compression=None)
                z = _gzip(_record(page_id, url, x.encode(), digest, length, first), level)
                out.write(z)
                n, size = n + 1, size + len(z)
                if size >= file_bytes:
                    close()
                    out, k = None, k + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=["path", "records", "bytes"])

    return lean(d, run, "path string, records long, bytes long")


class Reader:
    """Sequential reader of a .warc.gz: yields (headers, block) of each gzip member."""

    CHUNK = 4096

    def __init__(self, data: memoryview):
        self.data = data

    def __iter__(self) -> Iterator[tuple[dict, bytes]]:
        at, n = 0, len(self.data)
        while at < n:
            z, got, need, head = zlib.decompressobj(31), bytearray(), None, {}
            body = 0
            while not z.eof:
                if at >= n:
                    raise ValueError("the last member is cut off")
                step = self.data[at : at + self.CHUNK]
                got += z.decompress(step)
                at += len(step) - len(z.unused_data)
                if need is None and (end := got.find(b"\r\n\r\n")) >= 0:
                    lines = bytes(got[:end]).decode().split("\r\n")
                    if not lines[0].startswith("WARC/"):
                        raise ValueError("no WARC record starts here")
                    head = dict(x.split(": ", 1) for x in lines[1:])
                    body, need = end + 4, int(head["Content-Length"])
            if need is None or len(got) != body + need + 4 or not got.endswith(b"\r\n\r\n"):
                raise ValueError("the record's length isn't its Content-Length")
            yield head, bytes(memoryview(got)[body : body + need])


def _page(urn: str) -> int | None:
    x = urn.strip("<>").removeprefix(_URN)
    return int(x) if x else None


def read_warc(spark: SparkSession, folder: str, files: DataFrame | None = None) -> DataFrame:
    """One row per record, with the payload of responses; a wrong digest raises an error.

    ``files`` is the stored result of ``write_warc``; without it all *.warc.gz of the folder are read.
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    if files is not None:
        names = files.select(F.col("path").alias("_name"))
        few = names.limit(SMALL_GROUPS + 1).count() <= SMALL_GROUPS
        found = found.join(F.broadcast(names) if few else names, F.element_at(F.split("path", "/"), -1) == F.col("_name"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        rows, size = [], 0
        for b in batches:
            for content in b.column(0):
                for head, block in Reader(memoryview(content.as_buffer())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = head["WARC-Type"]
                    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{head['WARC-Record-ID']}: the payload isn't the one that was written")
                    rows.append((_page(head["WARC-Record-ID"]), head["WARC-Target-URI"], kind, _page(head["WARC-Refers-To"]) if kind == "revisit" else None, payload if kind == "response" else None, length, digest))
                    size += len(payload)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return lean(found.select("content"), run, schema)
