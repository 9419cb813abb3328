"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and items become normal text: lower-cased ASCII, words parted by one space, a line feed between documents. Patterns
are windows of item words with a space on either side. Patterns of like length share a table set: a shift table over
hashed blocks says how far the search may jump, a zero shift leads to the bucket of patterns whose prefix ends in that
block, and direct comparison confirms each occurrence. Many stretches of a batch are searched in step with NumPy.

Patterns are slices of the items' text, held as arrays, and go to the executors as one broadcast per block of items of about
``block_bytes`` text (an item isn't cut: a longer one is a block of its own size); a larger benchmark is searched in several
passes, each with one block, and hits are united per word. No pass shuffles documents. Tables have four slots or more for each
block of the patterns, up to 2**24.

Defined cases: null or wordless texts have no words and no hits; an item without words is skipped; a null item_id is
skipped; item ids may be of any type; repeated items count once by item_id, as do windows that several items have, for each of
them; very long texts are searched whole; repeated documents each get a row; empty tables give no hits or no rows;
other columns of the documents are kept only by ``contamination(..., keep=[...])``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, pieces, saved, utf8, with_fields

_WORD = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_NORMAL = bytes((c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD else 0x20) for c in range(256))
CLASSES = (3, 6, 12, 24, 48)


def normal(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Normal text of all rows: each is a space, then words with a space after each; line feeds part the rows."""
    t = memoryview(raw.tobytes().translate(_NORMAL))
    a = np.frombuffer(b" " + b" \n ".join([t[off[i] : off[i + 1]] for i in range(len(off) - 1)]) + b" ", np.uint8)
    space = a == 32
    keep = np.ones(len(a), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return a[keep]


class Patterns:
    """Windows of item words as slices of one text, in classes of like length; ``item`` numbers the items' ids in ``names``."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = [i for i, _ in items]
        texts = [(t or "").encode() for _, t in items]
        text = normal(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]))
        self.text = np.concatenate([text, np.zeros(8, np.uint8)])
        space = np.flatnonzero((text[:-1] == 32) & (text[1:] > 32))  # before each word
        after = np.flatnonzero((text[1:] == 32) & (text[:-1] > 32)) + 1  # and behind it
        feed = np.flatnonzero(text == 10)
        first = np.searchsorted(space, np.concatenate([[0], feed, [len(text)]]))[: len(items) + 1]
        count = np.diff(first)
        k = np.minimum(window, count)
        number = np.where(count > 0, count - k + 1, 0)
        item = np.repeat(np.arange(len(items)), number)
        word = np.arange(len(item)) - np.repeat(np.cumsum(number) - number, number) + first[item]
        at, size = space[word], after[word + k[item] - 1] + 1 - space[word]
        self.classes = []
        for lo, hi in zip(CLASSES, (*CLASSES[1:], 1 << 60)):
            own = (lo <= size) & (size < hi)
            if own.any():
                self.classes.append(WuManber(self.text, at[own], size[own], k[item[own]], item[own]))


class WuManber:
    """Tables over patterns text[at : at + size]; there are some slots for each block of the patterns, so that most others skip."""

    LEAST_BITS, MOST_BITS = 18, 24

    def __init__(self, text: np.ndarray, at: np.ndarray, size: np.ndarray, words: np.ndarray, item: np.ndarray):
        self.m = m = int(size.min())
        self.block = b = min(8, max(2, m // 3))
        self.text, self.at, self.len, self.words, self.item = text, at.astype(np.int64), size.astype(np.int32), words.astype(np.int32), item.astype(np.int32)
        self.bits = min(self.MOST_BITS, max(self.LEAST_BITS, int(self.covered()).bit_length() + 2))
        self.shift = np.full(1 << self.bits, m - b + 1, np.int16 if m < 1 << 15 else np.int32)
        for j in range(b, m + 1):  # blocks that end after j bytes of the prefix
            np.minimum.at(self.shift, self.hash(text, self.at + j - b), m - j)
        last = self.hash(text, self.at + m - b)
        self.order = np.argsort(last, kind="stable").astype(np.int32)
        self.bucket = np.searchsorted(last[self.order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def covered(self) -> int:
        """Bytes of text on which a block of a pattern's prefix starts: at least as many as there are different blocks."""
        change = np.zeros(len(self.text) + 1, np.int64)
        np.add.at(change, self.at, 1)
        np.add.at(change, self.at + self.m - self.block + 1, -1)
        return int((np.cumsum(change) > 0).sum())

    def hash(self, a: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Of the block of bytes from each start; a has 8 bytes to spare."""
        words = np.ndarray((len(a) - 7,), "<u8", a, strides=(1,))
        with np.errstate(over="ignore"):
            x = (words[start] << np.uint64(64 - 8 * self.block)) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, a: np.ndarray, n: int, lane: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(position, pattern) of all occurrences in a[:n]; a has 8 bytes to spare."""
        if n < self.m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos = np.arange(self.m, n + 1, lane)  # one past the window's end
        stop = np.minimum(pos + lane, n + 1)
        hits = []
        while len(pos):
            h = self.hash(a, pos - self.block)
            s = self.shift[h].astype(np.int64)
            zero = s == 0
            if zero.any():
                hits.append(np.stack([pos[zero] - self.m, h[zero]]))
            pos = pos + np.maximum(s, 1)
            on = pos < stop
            pos, stop = pos[on], stop[on]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, h = np.concatenate(hits, axis=1)
        count = (self.bucket[h + 1] - self.bucket[h]).astype(np.int64)
        at = np.repeat(at, count)
        slot = np.repeat(self.bucket[h] - (np.cumsum(count) - count), count) + np.arange(len(at))
        which = self.order[slot]
        same = at + self.len[which] <= n
        at, which = at[same], which[same]
        for k in range(int(self.len.max())):  # direct comparison, byte by byte while any pair is left
            if not len(at):
                break
            inside = k < self.len[which]
            ok = ~inside | (a[np.where(inside, at + k, 0)] == self.text[np.where(inside, self.at[which] + k, 0)])
            at, which = at[ok], which[ok]
        return at, which


def _search_rows(raw: np.ndarray, off: np.ndarray, patterns: Patterns):
    """Per row: number of words, hit flags of all words (concatenated), pairs (row, item)."""
    rows = len(off) - 1
    text = normal(raw, off)
    n = len(text)
    a = np.concatenate([text, np.zeros(8, np.uint8)])
    space = np.flatnonzero((a[: n - 1] == 32) & (a[1:n] > 32)) if n > 1 else np.zeros(0, np.int64)
    feed = np.flatnonzero(text == 10)
    first = np.searchsorted(space, np.concatenate([[0], feed, [n]]))  # first word of each row
    change = np.zeros(len(space) + 1, np.int32)
    pairs = []
    for c in patterns.classes:
        at, which = c.search(a, n)
        if len(at):
            word = np.searchsorted(space, at)
            np.add.at(change, word, 1)
            np.add.at(change, word + c.words[which], -1)
            row = np.searchsorted(feed, at)
            key = np.unique(np.stack([row, c.item[which].astype(np.int64)]), axis=1)
            pairs += [(int(r), patterns.names[i]) for r, i in key.T]
    return np.diff(first), np.cumsum(change[:-1]) > 0, first, pairs, rows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", keep: list[str] | None = None, block_bytes: int = 8 << 20) -> DataFrame:
    """Each document with n_words, n_hit, items (sorted ids), n_items, items_sha256, contaminated."""
    keep = docs.columns if keep is None else keep
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size["b"] * 2 // block_bytes)) if size["b"] > block_bytes else 1
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "_hit"]
    own = [c for c in keep if c not in added]
    d = docs.select(*own, F.col(text).alias("_text"))
    schema = with_fields(d, "n_words long, n_hit long, _hit binary, items array<string>")
    sc = docs.sparkSession.sparkContext
    for k in range(blocks):
        own_items = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        shared = sc.broadcast(Patterns([(r["item_id"], r["text"]) for r in own_items.distinct().toLocalIterator()], window))
        d = lean(d, _pass(shared, k > 0), schema)
        if k + 1 < blocks:
            d = saved(d)
    kind = benchmark.schema["item_id"].dataType
    return d.select(
        *own,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.array_sort(F.transform("items", lambda x: x.cast(kind))).alias("items"),
    )


def _pass(shared, again: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = shared.value
        for b in batches:
            base = b.drop_columns(["n_words", "n_hit", "_hit", "items"]) if again else b
            raw_all, off_all = utf8(b.column("_text"))
            words, hits, flags, items = [], [], [], []
            for i, j in pieces(off_all, 4 << 20):
                raw, off = raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i]
                n, hit, first, pairs, rows = _search_rows(raw, off, patterns)
                own: list[set] = [set() for _ in range(rows)]
                for r, item in pairs:
                    own[r].add(item)
                words += n.tolist()
                any_hit = np.add.reduceat(np.append(hit, False).astype(np.int64), np.minimum(first[:-1], len(hit))) * (n > 0) if rows else []
                for r in range(rows):
                    before = b.column("_hit")[i + r].as_py() if again else None
                    if before or any_hit[r]:
                        f = hit[first[r] : first[r + 1]]
                        if before:
                            f = f | np.unpackbits(np.frombuffer(before, np.uint8), count=len(f)).astype(bool)
                        hits.append(int(f.sum()))
                        flags.append(np.packbits(f).tobytes())
                    else:
                        hits.append(0)
                        flags.append(None)
                    if again:
                        own[r].update(b.column("items")[i + r].as_py())
                items += [sorted(x) for x in own]
            yield pa.RecordBatch.from_arrays([*base.columns, pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(flags, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=[*base.schema.names, "n_words", "n_hit", "_hit", "items"])

    return run
