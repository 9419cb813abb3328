"""N-gram Jaccard self-join with a count-vector R-tree.

Two documents link when 100 * |A & B| >= 75 * |A | B| for their sets of 5-word shingles, which is
7 * |A & B| >= 3 * (|A| + |B|). Words are hashed by tables of random numbers, not by a polynomial, so no structure of a text makes
its hash meet another's. Equal sets are one class; sets are told apart by 128 bits of two independent hashes, shingles of
different classes by 64.

1. One pass gives each document its set's size and class.
2. Linked sets share one of the first |A| - ceil(3|A|/4) + 1 shingles in any common order. The order is by
   the number of documents that hold a shingle (in powers of two, counted over all documents), then by hash, so passages
   and frequent phrases make no candidates. Hashed shingles are counted in groups, 64 or a quarter of the set's size; summed coordinate minima of two count vectors bound the overlap.
   Up to ``pair_run`` classes that share such a shingle make pairs, and the bound drops most. More classes are tied to
   the first of them, so no group is paired out. Tied classes form a cell. No link leaves a cell. Shingles travel packed,
   by hash buckets; a bucket is read as a stream with bounded memory.
3. In each cell the count vectors are points of an R-tree; a node's coordinate maxima bound the overlap with a query
   likewise. Surviving pairs are verified on the whole sets (without ``links`` only those that aren't connected yet). A
   spanning set of links and each class's count of linked documents leave the task. A cell over ``cell_shingles`` is cut into blocks: each
   holds a tree of its own and reads all members of the cell as a stream of queries.
4. Links make components; a document's component is the smallest doc_id.

Defined cases: null, empty and wordless texts have no shingle and link with nothing; very long texts are shingled whole; null ids rank as the smallest and
give a null component_id if they are the smallest; ids that aren't integers rank as text; repeated rows each get a row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import Cell, class_table, component_rows, verified
from .common import lean, saved, written
from .components import components
from .shingles import Names, id_key, sets_of, told_apart

GROUPS = 64


class Heavy:
    """Levels (base-2 logarithm of the number of documents) of shingles that many documents hold; all others have level 0."""

    def __init__(self, codes: np.ndarray, levels: np.ndarray):
        order = np.lexsort((-levels, codes))
        self.codes, self.levels = codes[order], levels[order]

    @staticmethod
    def code(keys: np.ndarray) -> np.ndarray:
        """32 bits of the hash; shingles that share a code share a level, which moves only the order."""
        return (keys >> np.uint64(32)).astype(np.uint32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(keys), np.int8)
        code = self.code(keys)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.levels[at], 0)


def prefix(s: np.ndarray, heavy: Heavy) -> np.ndarray:
    """The shingles of which linked sets share one: the first of the order (by level, then by hash)."""
    n = len(s)
    level = heavy.of(s)
    if level.any():
        s = s[np.argsort(level, kind="stable")]
    return s[: n - -(-3 * n // 4) + 1]


def _parts(sets: Iterator[tuple[np.ndarray, int]], most: int = 1_000_000) -> Iterator[list[tuple[np.ndarray, int]]]:
    """The (set, name) pairs in lists of about so many shingles."""
    held, size = [], 0
    for s in sets:
        held.append(s)
        size += len(s[0])
        if size >= most:
            yield held
            held, size = [], 0
    yield held


def _blobs(buckets: int, keys: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    """Rows of (bucket, packed keys, packed values)."""
    at = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    cut = np.searchsorted(at[order], np.arange(buckets + 1))
    full = [b for b in range(buckets) if cut[b + 1] > cut[b]]
    cols = {"keys": keys, **more}
    packed = [pa.array([c[order[cut[b] : cut[b + 1]]].tobytes() for b in full], pa.binary()) for c in cols.values()]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *packed], names=["bucket", *cols])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[memoryview]]]:
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            yield row[0], row[1:]


def heavy_shingles(texts: DataFrame, buckets: int, width: int, least: int = 8, most: int = 16_000_000) -> Heavy:
    """Shingles that many documents hold: at least ``least``, and at most ``most`` of them, of 5 bytes each.

    Only the order depends on them, not the links. But what the table lacks counts as rare, and ties all its documents: a table
    that doesn't grow with the corpus (2,800,000 shingles at 6 GB) makes a few cells of most of it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sets in _parts(sets_of(b, width, False)):
                keys, n = np.unique(np.concatenate([*(s for s, _ in sets), np.zeros(0, np.uint64)]), return_counts=True)
                blob = _blobs(buckets, keys, counts=n.astype(np.int32))
                high = [np.ascontiguousarray(np.frombuffer(k, np.uint32)[1::2]).tobytes() for k in blob.column("keys").to_pylist()]
                yield pa.RecordBatch.from_arrays([blob.column("bucket"), pa.array(high, pa.binary()), blob.column("counts")], names=["bucket", "keys", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts = None, [], []

        def total() -> pa.RecordBatch:
            k, c = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(k)
            k, c = k[order], c[order]
            at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            n = np.add.reduceat(c.astype(np.int64), at)
            on = n >= least
            return pa.RecordBatch.from_arrays([pa.array(k[at][on].view(np.int32)), pa.array(np.log2(n[on]).astype(np.int8))], names=["code", "level"])

        for bucket, (k, c) in _by_bucket(batches):
            if bucket != now and keys:
                yield total()
                keys, counts = [], []
            now = bucket
            keys.append(np.frombuffer(k, np.uint32))
            counts.append(np.frombuffer(c, np.int32))
        if keys:
            yield total()

    packed = lean(texts, count, "bucket int, keys binary, counts binary")
    heavy = written(lean(packed.repartition(buckets, "bucket").sortWithinPartitions("bucket"), add, "code int, level byte"), "heavy")
    have, floor = 0, 63
    number = {r["level"]: r["count"] for r in heavy.groupBy("level").count().collect()}
    while floor > 0 and have + number.get(floor, 0) <= most:
        have += number.get(floor, 0)
        floor -= 1
    got = heavy.filter(F.col("level") > floor).toPandas()
    return Heavy(got["code"].to_numpy(np.int32).view(np.uint32), got["level"].to_numpy(np.int8))


def _ties(texts: DataFrame, heavy: Heavy, names: Names, buckets: int, width: int, pair_run: int) -> DataFrame:
    """(a, b, many): classes that share a prefix shingle, as all pairs of few or as ties of many to one of them."""
    shared = texts.sparkSession.sparkContext.broadcast(heavy)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = set()
            for sets in _parts(names.sets(b, width)):
                keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for s, c in sets:
                    if len(s) and c not in seen:
                        seen.add(c)
                        keys.append(prefix(s, shared.value))
                        owners.append(np.full(len(keys[-1]), c))
                yield _blobs(buckets, np.concatenate(keys), owners=np.concatenate(owners))

    def rows(pair: np.ndarray, many: bool) -> pa.RecordBatch:
        pair = np.unique(np.sort(pair, axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(np.full(pair.shape[1], many))], names=["a", "b", "many"])

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fresh = None, 0
        keys, owners, large = [], [], np.zeros(0, np.uint64)  # of a large run only one entry is kept

        def merge() -> pa.RecordBatch:
            nonlocal keys, owners, large
            k, o = np.concatenate(keys), np.concatenate(owners)
            order = np.lexsort((o, k))
            k, o = k[order], o[order]
            on = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
            k, o = k[on], o[on]
            at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(at, len(k)))
            big = (size > pair_run) | np.isin(k[at], large)
            member = np.repeat(big, size)
            leader = np.repeat(o[at], size)
            pair = np.stack([leader[member], o[member]])
            large = k[at][big]
            keep = ~member
            keep[at] = True
            keys, owners = [k[keep]], [o[keep]]
            return rows(pair[:, pair[0] != pair[1]], True)

        def pairs() -> pa.RecordBatch:
            k, o = keys[0], owners[0]
            found = [np.zeros((2, 0), np.int64)]
            for d in range(1, pair_run):
                same = np.flatnonzero(k[d:] == k[:-d]) if len(k) > d else np.zeros(0, np.int64)
                if not len(same):
                    break
                found.append(np.stack([o[same], o[same + d]]))
            return rows(np.concatenate(found, axis=1), False)

        for bucket, (k, o) in _by_bucket(batches):
            if keys and (bucket != now or fresh >= 2_000_000):
                yield merge()
                fresh = 0
            if bucket != now:
                if keys:
                    yield pairs()
                now, keys, owners, large = bucket, [], [], np.zeros(0, np.uint64)
            keys.append(np.frombuffer(k, np.uint64))
            owners.append(np.frombuffer(o, np.int64))
            fresh += len(keys[-1])
        if keys:
            yield merge()
            yield pairs()

    packed = lean(texts, emit, "bucket int, keys binary, owners binary")
    return lean(packed.repartition(buckets, "bucket").sortWithinPartitions("bucket"), tie, "a long, b long, many boolean")


def _within_bound(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose summed minima of counts allow a link."""
    for side in "ab":
        c = classes.select(F.col("name").alias(side), F.col("counts").alias(f"c{side}"))
        pairs = pairs.join(c, side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [b.column(c).to_pylist() for c in ("ca", "cb")]
            wide = np.array([[len(v) for v in x] for x in sides]).reshape(2, -1)
            on = np.zeros(b.num_rows, bool)
            for p, q in np.unique(wide, axis=1).T if b.num_rows else ():
                at = np.flatnonzero((wide[0] == p) & (wide[1] == q))
                least = min(p, q)
                raw = [np.frombuffer(b"".join([v[i] for i in at]), np.uint8).reshape(len(at), -1, least) for v in sides]
                full = (raw[0].max((1, 2)) == 255) | (raw[1].max((1, 2)) == 255)  # a clipped count bounds nothing
                x, y = (v.sum(1, dtype=np.int64) for v in raw)
                m, n = x.sum(1), y.sum(1)
                on[at] = (4 * np.minimum(m, n) >= 3 * np.maximum(m, n)) & (7 * np.minimum(x, y).sum(1) >= 3 * (m + n)) | full
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(on)) for c in "ab"], names=["a", "b"])

    return lean(pairs.select("a", "b", "ca", "cb"), run, "a long, b long")


class RTree:
    """Over count vectors: leaves of near points, and per node the coordinate maxima and the least set size."""

    LEAF, FAN = 32, 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes, self.visited, self.pruned = points, sizes, 0, 0
        leaves, stack = [], [np.arange(len(points))]
        while stack:
            own = stack.pop()
            if len(own) <= self.LEAF:
                leaves.append(own)
                continue
            spread = points[own].max(0) - points[own].min(0)
            by = sizes[own] if 8 * (sizes[own].max() - sizes[own].min()) > sizes[own].max() else points[own, int(spread.argmax())]
            order = np.argsort(by, kind="stable")
            half = len(own) // 2
            stack += [own[order[half:]], own[order[:half]]]
        self.leaves = leaves
        top = np.stack([points[x].max(0) for x in leaves]), np.array([sizes[x].min() for x in leaves]), np.array([sizes[x].max() for x in leaves])
        self.levels = [top]
        while len(top[1]) > self.FAN:
            at = np.arange(0, len(top[1]), self.FAN)
            top = np.maximum.reduceat(top[0], at, axis=0), np.minimum.reduceat(top[1], at), np.maximum.reduceat(top[2], at)
            self.levels.append(top)

    def search(self, q: np.ndarray, size: int) -> np.ndarray:
        """Points whose bound lets them link with q."""
        nodes = np.arange(len(self.levels[-1][1]))
        for k in range(len(self.levels) - 1, -1, -1):
            high, low, most = (x[nodes] for x in self.levels[k])
            ok = (4 * low <= -(-16 * size // 3)) & (4 * most >= 3 * size)
            ok &= 7 * np.minimum(high, q).sum(1) >= 3 * (size + low)
            self.visited, self.pruned = self.visited + len(nodes), self.pruned + int((~ok).sum())
            nodes = nodes[ok]
            if k and len(nodes):
                nodes = (nodes[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                nodes = nodes[nodes < len(self.levels[k - 1][1])]
        if not len(nodes):
            return np.zeros(0, np.int64)
        own = np.concatenate([self.leaves[x] for x in nodes])
        return own[7 * np.minimum(self.points[own], q).sum(1) >= 3 * (size + self.sizes[own])]


def groups_of(n: int) -> int:
    """A power of two that leaves at most four shingles a group; vectors fold into any smaller power by adding up."""
    return max(GROUPS, 1 << max(0, (n + 3) // 4 - 1).bit_length())


def count_vector(s: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int32)


class TreeCell(Cell):
    """A cell whose candidates come from the tree."""

    def __init__(self, names: np.ndarray, sets: list[np.ndarray], copies: np.ndarray):
        super().__init__(names, sets, copies)
        self.groups = groups_of(int(np.median(self.sizes)))
        while self.groups > GROUPS and self.groups * len(sets) > 1 << 24:
            self.groups //= 2
        self.tree = RTree(np.stack([count_vector(s, self.groups) for s in sets]), self.sizes)

    def near(self, i: int, every: bool) -> np.ndarray:
        near = self.tree.search(self.tree.points[i], int(self.sizes[i]))
        return near[near > i] if every else near[(near != i) & (self.label[near] != self.label[i])]

    def near_set(self, s: np.ndarray) -> np.ndarray:
        return self.tree.search(count_vector(s, self.groups), len(s))


def jaccard_components(docs: DataFrame, width: int = 5, bucket_shingles: int = 1_000_000, cell_shingles: int = 2_000_000, few_members: int = 400_000, pair_run: int = 16, links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id of each document; with ``links`` also n_links, the number of documents it links with.

    Components need a spanning set of links only; counts need every pair of a group of near copies verified.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    key, restore = id_key(docs)
    own = docs.select("doc_id", key.alias("_id"), F.col("text").alias("_text"))
    id_kind = own.schema["_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = Names()
        for b in batches:
            n, c, k, v = [], [], [], []
            for s, check in sets_of(b, width, True):
                n.append(len(s))
                c.append(first.of(s, check) if len(s) else None)
                k.append(check)
                v.append(np.minimum(count_vector(s, groups_of(len(s))), 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_id"), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(k, pa.int64()), pa.array(v, pa.binary())], names=["doc_id", "_id", "n_shingles", "name", "check", "counts"])

    known, names = told_apart(saved(lean(own, describe, f"doc_id {kind}, _id {id_kind}, n_shingles long, name long, check long, counts binary")))
    vectors = known.filter("name IS NOT NULL").select("name", "counts").dropDuplicates(["name"])
    known = known.drop("counts")
    classes = class_table(known)
    total = known.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // (3 * bucket_shingles)))
    texts = own.select("_text")
    heavy = heavy_shingles(texts, buckets, width)
    ties = saved(_ties(texts, heavy, names, buckets, width, pair_run))
    close = _within_bound(ties.filter("NOT many").select("a", "b").distinct(), vectors)
    cells = components(ties.filter("many").select("a", "b").unionByName(close))
    found = verified(own, cells, classes, names, TreeCell, width, cell_shingles, few_members, links)
    return component_rows(known, classes, found, restore, links)
