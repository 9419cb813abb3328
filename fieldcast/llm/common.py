"""Shared helpers: tables, the shared scratch folder, and text as Arrow buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master may go without one: it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fieldcast-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Tables made in here drop their shuffle files as their action ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder (``spark.cleaner.referenceTracking.cleanCheckpoints`` clears it).

    The result no longer needs the shuffles before it, so their files go at once.
    """
    shared_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


_FOLDERS: list[str] = []


def new_folder(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder, which ``clear`` deletes."""
    _FOLDERS.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder (columnar, so later reads can prune)."""
    path = new_folder(df.sparkSession, what)
    with shuffles_freed(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the tables and archives that this process wrote to the shared folder; call it once results are stored."""
    n = 0
    while _FOLDERS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


KEPT: dict = {}  # what a worker keeps between tasks


def lean(df: DataFrame, run: Callable, schema: str | StructType, keep: bool = False) -> DataFrame:
    """``df.mapInArrow(run, schema)``; batches are cut by rows and bytes, and a worker that has ended its task gives its memory back.

    What a worker has in ``KEPT`` stays for the next task with ``keep``, and goes as a task without it begins.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, min(BATCH_ROWS, BATCH_BYTES * b.num_rows // max(1, b.nbytes)))
            for i in range(0, b.num_rows, step):
                yield b.slice(i, step)

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            KEPT.clear()
        try:
            yield from run(cut(batches))
        finally:
            release()

    return df.mapInArrow(call, schema)


def with_fields(df: DataFrame, added: str, *gone: str) -> StructType:
    """The schema of a table without some columns and with others at its end."""
    return StructType([*(f for f in df.schema.fields if f.name not in gone), *StructType.fromDDL(added).fields])


def release() -> None:
    """Give freed memory back to the system."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(letter: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the runs of flagged bytes; a run ends where its row ends."""
    flag = np.zeros(len(letter) + 2, np.int8)
    flag[1:-1] = letter
    edge = np.diff(flag)
    cut = np.unique(off[(off > 0) & (off < len(letter))])
    cut = cut[(flag[cut] == 1) & (flag[cut + 1] == 1)]  # rows that meet inside a run
    start = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut]))
    end = np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
    return start, end, np.searchsorted(off, start, side="right") - 1


def hash_words(a: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """64-bit polynomial hash of each a[start:end] (modulo 2**64, odd base), from one running sum; bytes count as these values."""
    n = len(a)
    if not len(start):
        return np.zeros(0, np.uint64)
    power = _powers(n + 1)
    run = np.empty(n + 1, np.uint64)
    run[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum((a.astype(np.uint64) + np.uint64(1) if values is None else values[a]) * power[1][:n], out=run[1:])
        return mix((run[end] - run[start]) * power[0][start])


SLOTS = 64
_TABLES: dict[int, np.ndarray] = {}


def keyed_words(a: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each a[start:end] (none empty): a sum of random numbers drawn for each byte at each place.

    Two different strings agree with probability 2**-64 over the tables, whatever their structure; seeds give independent
    hashes. Strings over 64 bytes are hashed by pieces of 64.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    if seed not in _TABLES:
        _TABLES[seed] = np.random.Generator(np.random.PCG64(0x5EED + seed)).integers(0, 1 << 64, SLOTS * 256, np.uint64)
    size = end - start
    before = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(before, size)
    byte = a[place + np.repeat(start, size)]
    slot = place & (SLOTS - 1)
    number = _TABLES[seed][slot * 256 + byte]
    with np.errstate(over="ignore"):
        if int(size.max()) <= SLOTS:
            return mix(np.add.reduceat(number, before))
        at = np.flatnonzero(slot == 0)
        piece = mix(np.add.reduceat(number, at)) + (place[at] // SLOTS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        piece = np.where(place[at] == 0, piece, mix(piece))
        return np.add.reduceat(piece, np.searchsorted(at, before))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the inverse base (0) and of the base (1)."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        base = 0x9E3779B97F4A7C15
        out = []
        for b in (pow(base, -1, 1 << 64), base):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(p, out=p)
            out.append(p)
        _POWERS[:] = out
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))
