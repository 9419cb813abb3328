"""Sets of hashed word shingles, and classes of equal sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import keyed_words, mix, pieces, utf8, word_spans

NULL_ID = -(1 << 63)
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_TIMES = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C14, 0xC2B2AE3D27D4EB4E, 0x165667B19E3779F8, 0x27D4EB2F165667C4, 0x85EBCA77C2B2AE62, 0xD6E8FEB86659FD92)]


def _long(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of so many words."""
    out = np.zeros(max(0, len(words) - width + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out += words[k : k + len(out)] * _TIMES[k % 6] if k < 6 else mix(words[k : k + len(out)] + np.uint64(k))
    return mix(out)


def _short(words: np.ndarray) -> np.ndarray:
    total = sum(int(w) * int(_TIMES[k % 6]) for k, w in enumerate(words)) + len(words) * 0x632BE59BD9B4E019
    return mix(np.array([total & 0xFFFFFFFFFFFFFFFF], np.uint64))


def checked_sets(raw: np.ndarray, off: np.ndarray, width: int, check: bool = True) -> Iterator[tuple[np.ndarray, int]]:
    """Of each row: sorted distinct shingle hashes, and with ``check`` 64 bits of the set by an independent word hash (else 0)."""
    a = np.frombuffer(raw.tobytes().translate(_LOWER), np.uint8)
    start, end, row = word_spans(_WORD[a], off)
    hashes = [keyed_words(a, start, end, seed) for seed in range(1 + check)]
    first = np.searchsorted(row, np.arange(len(off)))
    long = [_long(w, width) for w in hashes]
    for i, j in zip(first, first[1:]):
        if j == i:
            yield np.zeros(0, np.uint64), 0
        elif j - i < width:
            yield _short(hashes[0][i:j]), _digest(_short(hashes[1][i:j])) if check else 0
        elif not check:
            yield np.unique(long[0][i : j - width + 1]), 0
        else:
            s, at = np.unique(long[0][i : j - width + 1], return_index=True)
            yield s, _digest(long[1][i : j - width + 1][at])


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    return [s for s, _ in checked_sets(raw, off, width, False)]


def _digest(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        x = mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
        y = mix(s + np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
        z = mix(np.array([x ^ (y << np.uint64(1)) ^ np.uint64(len(s))], np.uint64))
    return int(z.view(np.int64)[0])


class Names:
    """64-bit names of classes of equal sets. Sets that agree in them but not in the check have other names, listed in ``moved``."""

    def __init__(self, moved: dict[tuple[int, int], int] | None = None):
        self.moved = moved or {}

    def of(self, s: np.ndarray, check: int) -> int:
        name = _digest(s)
        return self.moved.get((name, check), name) if self.moved else name

    def sets(self, batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, int]]:
        """(set, name) of each row's ``_text``; an empty set has name 0."""
        for s, check in sets_of(batch, width, bool(self.moved)):
            yield s, self.of(s, check) if len(s) else 0


def id_key(docs: DataFrame, name: str = "doc_id") -> tuple[Column, Callable[[Column], Column]]:
    """An id that isn't null and sorts as the column does, null first, and the way back: integers as long, all else as text."""
    field = docs.schema[name]
    if isinstance(field.dataType, IntegralType):
        return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID)), lambda x: F.when(x != NULL_ID, x).cast(field.dataType)
    return F.coalesce(F.concat(F.lit("s"), F.col(name).cast("string")), F.lit("")), lambda x: F.when(x != "", F.substring(x, 2, 1 << 30)).cast(field.dataType)


def sets_of(batch: pa.RecordBatch, width: int, check: bool) -> Iterator[tuple[np.ndarray, int]]:
    raw, off = utf8(batch.column("_text"))
    for i, j in pieces(off, 1 << 20):
        yield from checked_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], width, check)


def told_apart(known: DataFrame) -> tuple[DataFrame, Names]:
    """``known`` (name, check, ...) with names that different sets don't share, and what was renamed.

    Sets are told apart by 128 bits. That two share the first 64 is a matter of 2**-64 a pair, so the list of those is short.
    """
    both = known.filter("name IS NOT NULL").groupBy("name").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi").select("name")
    if both.isEmpty():
        return known, Names()
    pairs = known.join(F.broadcast(both), "name").select("name", "check").distinct().withColumn("new", F.xxhash64("name", "check"))
    moved = {(r["name"], r["check"]): r["new"] for r in pairs.collect()}
    renamed = known.join(F.broadcast(pairs.withColumnsRenamed({"name": "_n", "check": "_c"})), (F.col("name") == F.col("_n")) & (F.col("check") == F.col("_c")), "left")
    return renamed.withColumn("name", F.coalesce("new", "name")).drop("_n", "_c", "new"), Names(moved)
