"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.

1. Copies of a whole text are found by SHA-256: later ones go whole, the first goes on.
2. Each string has a key: the least hash of its ``gram``-byte substrings. Equal strings have equal keys, and neighbouring
   strings mostly share one, so a run of strings with one key travels as one segment of text. Keys that documents of one id
   only have are dropped first (keys travel packed, by hash buckets, with the ids of their holders in that bucket).
3. Segments with a key meet in its bucket, each distinct one once (compared where hashes are equal). Shards
   of segments each have their strings in suffix order and, for each depth, a sorted dictionary of preceding blocks and their
   sequence as places in it (the transform in blocks of 8 bytes, the last one overlapping). The merge starts with the shards
   one after another and refines the interleave depth by depth: dictionaries are merged, blocks become ranks in the merged
   one, and the present interleave is dealt by rank in counting passes. No suffix is compared. The same pass carries the
   boundaries where common prefixes end; strings between two boundaries after the last depth are equal (a repeated interval).
4. In each repeated interval strings of documents over the least id are marked; each document unites its marks.

Hot keys and segments: what a batch of rows can tell by itself doesn't go through the bucket. Of a key that several ids of a
batch have, only the least holder is sent there; the others are known to share it. Of a segment likewise: later holders in
the batch lose it whole, whoever is first elsewhere. So a passage that all documents share sends one reference a batch, and a
bucket gives out keys as soon as they are known to be shared, and keeps one holder of each.

Defined cases: null text is empty; very long texts are cut into their runs like all others; a null id is the smallest, and ids must be integers; rows
with equal ids don't remove each other's bytes; repeated rows each get a row; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, keyed_words, lean, mix, pieces, saved, utf8

_NULL_ID = -(1 << 63)


def string_runs(a: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, row, key) of the runs of string starts with one key; strings never leave their row."""
    n = len(a)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64)
    start = np.arange(n - gram + 1)
    low = hash_words(a, start, start + gram)
    have, want = 1, length - gram + 1
    while have < want:
        step = min(have, want - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(low)]
    inside = np.arange(len(low)) + length <= off[row + 1]
    change = np.ones(len(low), bool)
    change[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    first = np.flatnonzero(change & inside)
    stop = np.append(np.flatnonzero(change | ~inside), len(low))
    last = stop[np.searchsorted(stop, first, side="right")] - 1
    return first, last, row[first], low[first]


def _bucketed(at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    order = np.argsort(at, kind="stable")
    cut = np.searchsorted(at[order], np.arange(buckets + 1))
    return order, cut, [b for b in range(buckets) if cut[b + 1] > cut[b]]


def _grouped(ids: np.ndarray, groups: int, values: np.ndarray, rks: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of (group of id, packed ids, packed row hashes, packed values, no text and so on): the columns of a bucket's rows."""
    rks = np.zeros(len(ids), np.int64) if rks is None else rks
    order, cut, full = _bucketed((mix(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int64), groups)
    packed = [pa.array([c[order[cut[g] : cut[g + 1]]].tobytes() for g in full], pa.binary()) for c in (ids, rks, values)]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *packed], names=["group", "ids", "rks", "values"])


_GROUPED = "group int, ids binary, rks binary, values binary"


def _by_row(packed: DataFrame, groups: int, name: str, unite) -> DataFrame:
    """(id, rk, value): all that the packed groups hold of each row, by ``unite(sorted values)`` of one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            ids, rk = (np.concatenate([np.frombuffer(x[k], np.int64) for x in held]) for k in (0, 1))
            values = np.concatenate([np.frombuffer(x[2], np.uint64) for x in held])
            order = np.lexsort((values, rk, ids))
            ids, rk, values = ids[order], rk[order], values[order]
            at = np.flatnonzero(np.concatenate([[True], (rk[1:] != rk[:-1]) | (ids[1:] != ids[:-1])])) if len(rk) else np.zeros(0, np.int64)
            end = np.append(at[1:], len(rk))
            return pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(rk[at], pa.int64()), pa.array([unite(values[x:y]) for x, y in zip(at, end)], pa.binary())], names=["id", "rk", name])

        for b in batches:
            for group, *values in zip(*(c.to_pylist() for c in b.columns)):
                if group != now and held:
                    yield done()
                    held = []
                now = group
                held.append(values)
        if held:
            yield done()

    return lean(packed.repartition(groups, "group").sortWithinPartitions("group"), run, f"id long, rk long, {name} binary")


def short(key: np.ndarray) -> np.ndarray:
    return key >> np.uint64(16)


def _first_of(what: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By sorted (what, id): (order, flag of the entries with the least id of their kind)."""
    order = np.lexsort((ids, what))
    w, i = what[order], ids[order]
    new = np.concatenate([[True], w[1:] != w[:-1]]) if len(w) else np.zeros(0, bool)
    least = i[np.flatnonzero(new)][np.cumsum(new) - 1] if len(w) else i
    return order, i == least


def _shared_keys(texts: DataFrame, buckets: int, groups: int, length: int, gram: int, held_keys: int = 4_000_000) -> DataFrame:
    """Packed pairs of an id and a key that documents of other ids have too, by group of ids."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = utf8(b.column("_text"))
            own_ids = b.column("_id").to_numpy()
            keys, holders = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, j in pieces(off, 1 << 20):
                _, _, row, key = string_runs(raw[off[i] : off[j]], off[i : j + 1] - off[i], length, gram)
                keys.append(short(key))
                holders.append(own_ids[row + i])
            yield _keys_of_batch(np.concatenate(keys), np.concatenate(holders), buckets)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, ids, fresh = None, [], [], 0
        known = np.zeros(0, np.uint64)

        def found() -> pa.RecordBatch:
            """Give out the pairs of shared keys; of these only the key stays, of others the pair."""
            nonlocal keys, ids, known
            k, i = np.concatenate(keys), np.concatenate(ids)
            order = np.lexsort((i, k))
            k, i = k[order], i[order]
            at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            end = np.append(at[1:], len(k))
            many = (i[at] != i[end - 1]) | np.isin(k[at], known)
            on = np.repeat(many, end - at)
            known = np.union1d(known, k[at][many])
            keys, ids = [k[at][~many]], [i[at][~many]]
            return _grouped(i[on], groups, k[on])

        for b in batches:
            for bucket, low, high, holder, holders in zip(*(c.to_pylist() for c in b.columns)):
                i = np.frombuffer(holders, np.int64)
                low = np.frombuffer(low, np.uint32)
                k = (np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32)) | low
                i = i[np.frombuffer(holder, np.uint16 if len(i) <= 1 << 16 else np.int32)]
                if bucket < 0:  # known to be shared
                    yield _grouped(i, groups, k)
                    continue
                if keys and (bucket != now or fresh > held_keys):
                    yield found()
                    fresh = 0
                if bucket != now:
                    now, keys, ids, known = bucket, [], [], np.zeros(0, np.uint64)
                keys.append(k)
                ids.append(i)
                fresh += len(k)
        if keys:
            yield found()

    packed = lean(texts, emit, "bucket int, low binary, high binary, holder binary, holders binary")
    return lean(_dealt(packed, buckets), share, _GROUPED)


def _dealt(packed: DataFrame, buckets: int) -> DataFrame:
    """Rows of a bucket in one task; rows that need no bucket (-1 - any number) are spread by their number."""
    place = F.when(F.col("bucket") < 0, F.pmod(-F.col("bucket"), F.lit(buckets))).otherwise(F.col("bucket"))
    return packed.withColumn("_place", place).repartition(buckets, "_place").drop("_place").sortWithinPartitions("bucket")


def _keys_of_batch(key: np.ndarray, ids: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A batch's pairs by bucket: of each key the least holder, and apart (bucket under 0) the pairs of keys of several ids."""
    order, first = _first_of(key, ids)
    key, ids = key[order], ids[order]
    one = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])]) if len(key) else np.zeros(0, bool)
    key, ids, first = key[one], ids[one], first[one]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    several = np.repeat(np.diff(np.append(at, len(key))) > 1, np.diff(np.append(at, len(key))))
    rows = []

    def add(bucket: int, k: np.ndarray, i: np.ndarray) -> None:
        holders, at = np.unique(i, return_inverse=True)
        rows.append((bucket, k.astype(np.uint32).tobytes(), (k >> np.uint64(32)).astype(np.uint16).tobytes(), at.astype(np.uint16 if len(holders) <= 1 << 16 else np.int32).tobytes(), holders.tobytes()))

    if several.any():
        add(-1 - int(ids[several][0] & 0x3FFFFFFF), key[several], ids[several])
    key, ids = key[first], ids[first]
    order, cut, full = _bucketed((key % np.uint64(buckets)).astype(np.int64), buckets)
    for k in full:
        own = order[cut[k] : cut[k + 1]]
        add(k, key[own], ids[own])
    cols = list(zip(*rows)) or [()] * 5
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["bucket", "low", "high", "holder", "holders"])


def offsets(length: int) -> list[int]:
    """Where the 8-byte blocks of a string start, from the last to the first."""
    return [*({length - 8} - set(range(0, length - 7, 8))), *sorted(range(0, length - 7, 8), reverse=True)]


def deal(rank: np.ndarray) -> np.ndarray:
    """Stable order by rank, in counting passes of 16 bits."""
    order = np.argsort((rank & 0xFFFF).astype(np.uint16), kind="stable")  # for 16 bits NumPy counts
    if len(rank) and rank.max() > 0xFFFF:
        order = order[np.argsort((rank[order] >> 16).astype(np.uint16), kind="stable")]
    return order


class Shard:
    """Strings of some segments: their suffix order, and for every depth the sorted dictionary of blocks and the block sequence."""

    def __init__(self, text: np.ndarray, lens: np.ndarray, length: int):
        blocks = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
        begin = np.cumsum(lens) - lens
        count = lens - length + 1
        self.segment = np.repeat(np.arange(len(lens)), count)
        self.within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = begin[self.segment] + self.within
        self.order = np.arange(len(at))
        self.before = []
        for o in offsets(length):
            b = blocks[at[self.order] + o].astype(np.uint64)
            by = np.argsort(b, kind="stable")
            b = b[by]
            new = np.ones(len(b), bool)
            new[1:] = b[1:] != b[:-1]
            code = np.empty(len(b), np.int64)
            code[by] = np.cumsum(new) - 1
            self.before.append((b[new], code))
            self.order = self.order[by]


def merge(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """Interleave refinement: (string, interval) in merged order; strings count through all shards."""
    sizes = [len(s.order) for s in shards]
    z = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)  # which shard the next suffix is from
    interval = np.zeros(len(z), np.int64)
    for depth in range(len(shards[0].before)):
        own = [s.before[depth] for s in shards]
        known = np.unique(np.concatenate([k for k, _ in own]))  # the dictionaries, merged
        rank = np.empty(len(z), np.int64)
        rank[np.argsort(z, kind="stable")] = np.concatenate([np.searchsorted(known, k)[code] for k, code in own])
        order = deal(rank)
        z, rank, old = z[order], rank[order], interval[order]
        edge = np.zeros(len(z), np.int64)
        edge[1:] = (rank[1:] != rank[:-1]) | (old[1:] != old[:-1])  # the common prefix ends before this depth
        interval = np.cumsum(edge)
    string = np.empty(len(z), np.int64)
    base = np.cumsum(sizes) - sizes
    string[np.argsort(z, kind="stable")] = np.concatenate([s.order + x for s, x in zip(shards, base)])
    return string, interval


def _distinct(text: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, lens, which) of the distinct segments.

    Segments of equal hash and length are compared with the first of them, byte by byte, and if any differs all are.
    """
    begin = np.cumsum(lens) - lens
    _, first, which = np.unique(keyed_words(text, begin, begin + lens, 0), return_index=True, return_inverse=True)
    same = np.array_equal(lens, lens[first[which]])
    if same:
        later = np.flatnonzero(first[which] != np.arange(len(lens)))
        size = lens[later]
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        same = np.array_equal(text[step + np.repeat(begin[later], size)], text[step + np.repeat(begin[first[which[later]]], size)])
    if not same:
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(text[x : x + n].tobytes(), len(seen)) for x, n in zip(begin, lens)])
        first = np.unique(which, return_index=True)[1]
    size = lens[first]
    at = np.repeat(begin[first] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return text[at], size, which


def _marks(segments: DataFrame, buckets: int, groups: int, length: int, shard_strings: int = 1 << 16) -> DataFrame:
    """Packed (id, rk) and (start, end) that the row loses, by group of ids.

    A bucket holds each distinct segment once, whatever the number of documents with it. Later documents lose all of their
    copy of a segment; the first one loses the strings that another segment's documents had before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def marks() -> pa.RecordBatch:
            base = np.cumsum([len(h[1]) for h in held]) - [len(h[1]) for h in held]
            text, lens, which = _distinct(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            segment = which[np.concatenate([h[2] + x for h, x in zip(held, base)])]
            rk, ids, start = (np.concatenate([h[k] for h in held]) for k in (3, 4, 5))
            first = np.full(len(lens), np.iinfo(np.int64).max)
            np.minimum.at(first, segment, ids)
            count = lens - length + 1
            total, begin = np.cumsum(count), np.cumsum(lens) - lens
            shards, i = [], 0
            while i < len(lens):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + shard_strings, side="right")))
                shards.append((i, Shard(text[begin[i] : begin[j - 1] + lens[j - 1]], lens[i:j], length)))
                i = j
            string, interval = merge([x for _, x in shards])
            owner = np.concatenate([x.segment + i for i, x in shards])
            own = first[owner[string]]
            at = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
            least = np.repeat(np.minimum.reduceat(own, at), np.diff(np.append(at, len(own))))
            gone = np.zeros(len(string), bool)
            gone[string] = own > least  # of each segment's first document
            flag = np.concatenate([[0], gone.view(np.int8), [0]])
            inner = np.ones(len(gone) + 1, bool)
            inner[np.concatenate([[0], total])] = False  # runs end with their segment
            a = np.flatnonzero((flag[1:] == 1) & ~((flag[:-1] == 1) & inner))
            b = np.flatnonzero((flag[:-1] == 1) & ~((flag[1:] == 1) & inner)) - 1
            run_segment, offset = owner[a], total - count
            later = ids > first[segment]
            spans = [np.stack([ids[later], rk[later], start[later], start[later] + lens[segment[later]]])]
            one = np.flatnonzero(~later)
            k = np.searchsorted(run_segment, segment[one]), np.searchsorted(run_segment, segment[one], side="right")
            n = k[1] - k[0]
            who = np.repeat(one, n)
            pick = np.repeat(k[0] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            spans.append(np.stack([ids[who], rk[who], start[who] + a[pick] - offset[segment[who]], start[who] + b[pick] - offset[segment[who]] + length]))
            lost, rks, s, e = np.concatenate(spans, axis=1)
            return _grouped(lost, groups, _span(s, e), rks)

        for b in batches:
            for bucket, text, lens, ref, rk, ids, start in zip(*(c.to_pylist() for c in b.columns)):
                if bucket < 0:  # spans of later holders
                    yield _grouped(np.frombuffer(ids, np.int64), groups, np.frombuffer(start, np.uint64), np.frombuffer(rk, np.int64))
                    continue
                if bucket != now and held:
                    yield marks()
                    held = []
                now = bucket
                held.append((np.frombuffer(text, np.uint8), np.frombuffer(lens, np.int32).astype(np.int64), np.frombuffer(ref, np.int32).astype(np.int64), np.frombuffer(rk, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(start, np.int64)))
        if held:
            yield marks()

    return lean(_dealt(segments, buckets), run, _GROUPED)


def _span(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (start.astype(np.uint64) << np.uint64(32)) | end.astype(np.uint64)


def _united(spans: np.ndarray) -> bytes:
    """A row's spans as few as can be, as sorted int32 pairs; they come sorted."""
    start, end = (spans >> np.uint64(32)).astype(np.int64), np.maximum.accumulate((spans & np.uint64(0xFFFFFFFF)).astype(np.int64))
    at = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return np.stack([start[at], end[np.append(at[1:], len(end)) - 1]], 1).astype(np.int32).tobytes()


def _segments(texts: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """Packed segments of the rows' shared keys, by bucket; a distinct segment's text goes once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = utf8(b.column("_text"))
            rks, ids = b.column("rk").to_numpy(), b.column("_id").to_numpy()
            for i, j in pieces(off, 1 << 20):
                a, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                first, last, row, key = string_runs(a, o, length, gram)
                shared = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in b.column("_keys").slice(i, j - i).to_pylist()]))
                on = np.isin(short(key), shared)
                first, last, row, key = first[on], last[on], row[on], key[on]
                order, cut, full = _bucketed((key % np.uint64(buckets)).astype(np.int64), buckets)
                first, lens, row = first[order], (last - first + length)[order], row[order]
                at = np.repeat(first - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
                text, cut_text = a[at], np.concatenate([[0], np.cumsum(lens)])[cut]
                begin, rk, holder = (first - o[row]).astype(np.int64), rks[row + i], ids[row + i]
                out, lost = [], [np.zeros(0, np.int64)]
                for k in full:
                    own = slice(cut[k], cut[k + 1])
                    part, size, which = _distinct(text[cut_text[k] : cut_text[k + 1]], lens[own])
                    least = np.full(len(size), np.iinfo(np.int64).max)
                    np.minimum.at(least, which, holder[own])
                    stays = holder[own] == least[which]
                    lost.append(np.flatnonzero(~stays) + cut[k])
                    out.append((k, part.tobytes(), size.astype(np.int32).tobytes(), which[stays].astype(np.int32).tobytes(), rk[own][stays].tobytes(), holder[own][stays].tobytes(), begin[own][stays].tobytes()))
                gone = np.concatenate(lost)
                if len(gone):
                    out.append((-1 - int(rk[gone[0]] & 0x3FFFFFFF), b"", b"", b"", rk[gone].tobytes(), holder[gone].tobytes(), _span(begin[gone], begin[gone] + lens[gone]).tobytes()))
                cols, kinds = list(zip(*out)) or [()] * 7, [pa.int32(), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["bucket", "text", "lens", "refs", "rks", "ids", "starts"])

    return lean(texts, run, "bucket int, text binary, lens binary, refs binary, rks binary, ids binary, starts binary")


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 30, bucket_strings: int = 400_000, group_bytes: int = 256 << 20, few_bytes: int = 32 << 20, few_rows: int = 1_000_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("_id"), text.alias("_text"), F.sha2(text, 256).alias("_digest"))
    d = d.withColumn("rk", F.xxhash64("_id", "_digest"))
    long = F.octet_length("_text") >= length
    copies = saved(d.filter(long).groupBy(F.col("_digest").alias("_d")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    few = copies.count() * 100 <= few_bytes
    d = d.join(F.broadcast(copies) if few else copies, F.col("_digest") == F.col("_d"), "left").withColumn("_copy", F.coalesce(F.col("_id") > F.col("_first"), F.lit(False)))
    firsts = d.filter(long & ~F.col("_copy")).select("rk", "_id", "_text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    parts = max(1, total // (length // 3 * bucket_strings * 2))
    groups = min(parts, max(64, total // group_bytes))
    shared = saved(_by_row(_shared_keys(firsts, parts, groups, length, gram), groups, "_keys", lambda k: np.unique(k).tobytes()).drop("rk"))
    rows, size = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_keys")), F.lit(0))).first()
    buckets = max(1, -(-(size // 8 * (length - gram) // 2) // bucket_strings))
    if rows <= few_rows:
        firsts = firsts.join(F.broadcast(shared.select(F.col("id").alias("_id"))), "_id", "left_semi")  # before texts are shuffled
    held = firsts.join(shared, F.col("_id") == F.col("id")).select("rk", "_id", "_text", "_keys")
    marks = _marks(_segments(held, buckets, length, gram), buckets, groups, length)
    marks = saved(_by_row(marks, groups, "_spans", _united).withColumnsRenamed({"rk": "_rk", "id": "_mid"}))
    few = (marks.agg(F.coalesce(F.sum(F.octet_length("_spans") + 64), F.lit(0))).first()[0]) <= few_bytes
    out = d.join(F.broadcast(marks) if few else marks, (F.col("rk") == F.col("_rk")) & (F.col("_id") == F.col("_mid")), "left").select("doc_id", "_text", "_copy", "_spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = utf8(b.column("_text"))
            rows = []
            for i, (copy, spans) in enumerate(zip(b.column("_copy").to_pylist(), b.column("_spans").to_pylist())):
                x = raw[off[i] : off[i + 1]]
                if copy:
                    rows.append((len(x), len(x), 1, b""))
                elif not spans:
                    rows.append((len(x), 0, 0, x.tobytes()))
                else:
                    pair = np.frombuffer(spans, np.int32).reshape(-1, 2)
                    kept = b"".join(x[p:q].tobytes() for p, q in zip(np.append(0, pair[:, 1]), np.append(pair[:, 0], len(x))))
                    rows.append((len(x), len(x) - len(kept), len(pair), kept))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return lean(out, finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
