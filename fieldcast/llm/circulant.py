"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Two documents link when 100 * |A & B| >= 80 * |A | B| for their sets of 4-word shingles, which is 9 * |A & B| >= 4 * (|A| + |B|).

1. A signature has 200 coordinates, made by two permutations of the 32-bit universe: the first scatters the shingles, the
   second, shifted by one place a coordinate, ranks them; a coordinate is the least rank. 40 bands of 5 coordinates make keys.
   Linked documents of Jaccard 0.8 share no band in one of 8 million pairs, those of 0.9 never in practice.
2. Equal sets are one class, told apart by 128 bits. Classes that share a band's key are candidates: up to ``pair_run`` of them as
   pairs, whose sizes and signatures must allow a link (120 of 200 coordinates agree, which is seven standard deviations below
   0.8); more are tied to the smallest of them, so no group is paired out. Tied classes form a cell.
3. Candidates within a cell are verified on the full sets, by members of other components only, so a group of near
   copies takes about one comparison a member. A cell over ``cell_shingles`` is cut into blocks.
4. Links make components; the smallest doc_id of a component is kept.

Defined cases: null, empty and wordless texts have no shingle, link with nothing and are kept; very long texts are hashed whole; null ids rank
as the smallest and give a null component_id if they are the smallest; ids that aren't integers rank as text; repeated rows each get a
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import Cell, class_table, component_rows, verified
from .common import lean, mix, written
from .components import components
from .shingles import Names, id_key, sets_of, told_apart

BANDS, ROWS = 40, 5
COORDINATES = BANDS * ROWS
AGREE = COORDINATES * 6 // 10
_CHUNK = 1 << 15


def _permuted(x: np.ndarray, a: int, b: int, spare: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place: shifts and odd products can be undone."""
    for times, shift in ((a, 16), (b, 15)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(times), out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    return np.bitwise_xor(x, spare, out=x)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of COORDINATES numbers for sets of shingle hashes, none empty."""
    out = np.empty((len(sets), COORDINATES), np.uint32)
    sizes = np.array([len(s) for s in sets])
    total, i = np.cumsum(sizes), 0
    while i < len(sets):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + _CHUNK, side="right")))
        keys = np.concatenate(sets[i:j])
        first = np.cumsum(sizes[i:j]) - sizes[i:j]
        x = (keys ^ (keys >> np.uint64(32))).astype(np.uint32)
        place, rank = np.empty_like(x), np.empty_like(x)
        _permuted(x, 0x7FEB352D, 0x846CA68B, place)
        for k in range(COORDINATES):
            np.subtract(x, np.uint32(k), out=rank)  # the circular shift
            out[i:j, k] = np.minimum.reduceat(_permuted(rank, 0x9E3779B1, 0x85EBCA77, place), first)
        i = j
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row's bands."""
    x = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), x.shape[:2])
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[:, :, k])
    return h.view(np.int64)


class SignatureCell(Cell):
    """A cell whose candidates are the members with enough equal coordinates (of which it holds eight bits)."""

    p, q = 9, 4

    def __init__(self, names: np.ndarray, sets: list[np.ndarray], copies: np.ndarray):
        super().__init__(names, sets, copies)
        self.marks = signatures(sets).astype(np.uint8)

    def _close(self, mark: np.ndarray, size: int, among: np.ndarray) -> np.ndarray:
        among = among[(5 * self.sizes[among] >= 4 * size) & (4 * self.sizes[among] <= 5 * size)]
        out = [np.zeros(0, np.int64)]
        for k in range(0, len(among), 4096):
            part = among[k : k + 4096]
            out.append(part[(self.marks[part] == mark).sum(1) >= AGREE])
        return np.concatenate(out)

    def near(self, i: int, every: bool) -> np.ndarray:
        among = np.arange(i + 1, len(self.sets)) if every else np.flatnonzero(self.label != self.label[i])
        return self._close(self.marks[i], int(self.sizes[i]), among)

    def near_set(self, s: np.ndarray) -> np.ndarray:
        return self._close(signatures([s])[0].astype(np.uint8), len(s), np.arange(len(self.sets)))


def _agreeing(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose signatures agree in enough coordinates."""
    for side in "ab":
        pairs = pairs.join(marks.select(F.col("name").alias(side), F.col("mark").alias(f"m{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ma, mb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("ma", "mb"))
            on = pa.array((ma == mb).sum(1) >= AGREE)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(on) for c in "ab"], names=["a", "b"])

    return lean(pairs.select("a", "b", "ma", "mb"), run, "a long, b long")


def _candidates(classes: DataFrame, pair_run: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs of few classes that share a key, and ties of many to the smallest of them; ``classes`` has (name, n, bands)."""
    keys = classes.select("name", "n", F.explode("bands").alias("key"))
    leaders = keys.groupBy("key").agg(F.min("name").alias("leader"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    shared = written(keys.join(leaders, "key"), "minhash-shared")
    ties = shared.filter((F.col("many") > pair_run) & (F.col("name") != F.col("leader"))).select(F.col("leader").alias("a"), F.col("name").alias("b")).distinct()
    runs = shared.filter(F.col("many") <= pair_run).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("name", "n"))).alias("run"))  # at most pair_run
    pairs = F.flatten(F.transform("run", lambda x, i: F.transform(F.slice("run", i + 2, F.lit(pair_run)), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    fits = (5 * F.least("p.x.n", "p.y.n") >= 4 * F.greatest("p.x.n", "p.y.n"))
    return runs.select(F.explode(pairs).alias("p")).filter(fits).select(F.col("p.x.name").alias("a"), F.col("p.y.name").alias("b")).distinct(), ties


def near_duplicates(docs: DataFrame, width: int = 4, cell_shingles: int = 2_000_000, few_members: int = 400_000, pair_run: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    key, restore = id_key(docs)
    own = docs.select("doc_id", key.alias("_id"), F.col("text").alias("_text"))
    id_kind = own.schema["_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = Names()
        for b in batches:
            sets = [(s, first.of(s, check) if len(s) else None, check) for s, check in sets_of(b, width, True)]
            new: dict[tuple, int] = {}  # of equal sets in a batch one has a signature
            for i, (s, name, check) in enumerate(sets):
                if len(s):
                    new.setdefault((name, check), i)
            at = sorted(new.values())
            marks, bands = [None] * len(sets), [None] * len(sets)
            if at:
                signature = signatures([sets[i][0] for i in at])
                for i, mark, band in zip(at, signature.astype(np.uint8), band_keys(signature)):
                    marks[i], bands[i] = mark.tobytes(), band
            cols = [pa.array([len(s) for s, _, _ in sets], pa.int64()), pa.array([c for _, c, _ in sets], pa.int64()), pa.array([k for _, _, k in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_id"), *cols, pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "_id", "n_shingles", "name", "check", "mark", "bands"])

    known, names = told_apart(written(lean(own, describe, f"doc_id {kind}, _id {id_kind}, n_shingles long, name long, check long, mark binary, bands array<long>"), "minhash"))
    one = written(known.filter("mark IS NOT NULL").select("name", F.col("n_shingles").alias("n"), "mark", "bands").dropDuplicates(["name"]), "minhash-classes")
    pairs, ties = _candidates(one, pair_run)
    close = _agreeing(pairs, one)
    known = known.drop("mark", "bands")
    classes = class_table(known)
    cells = components(ties.unionByName(close))
    found = verified(own, cells, classes, names, SignatureCell, width, cell_shingles, few_members, False)
    return component_rows(known, classes, found, restore, False).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
