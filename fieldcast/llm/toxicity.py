"""Toxicity: a factorization machine over hashed terms.

Terms are words (lower-cased ASCII letters, digits and non-ASCII characters) and their first four and five bytes; each
document has the set of its terms' hash buckets. The model is bias + linear weights + pairwise interactions of factor
vectors, fitted by AdaGrad on a bounded sample of labelled rows (``max_rows`` of each class, by a hash of doc_id) over the
terms whose log-odds differ from 0 by ``least_z`` standard errors, with the bias put back to the classes' true share. Scoring is one pass without a shuffle; the model's size is fixed by its parameters.

Defined cases: null or wordless texts score the bias; very long texts are scored whole, as sets of terms; null labels, labels
of a null doc_id and labels without a document are ignored; of repeated labels of a document the largest counts; with one
class or no labels the score is the smoothed share; repeated documents each get a row; an empty table gives an empty result;
other columns are kept, but for those named ``score``, which the score replaces, and ``_text``, which is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, lean, pieces, release, utf8, with_fields, word_spans

_LETTERS = np.zeros(256, bool)
_LETTERS[0x30:0x3A] = _LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    factors: int = 4
    max_rows: int = 10_000
    epochs: int = 40
    batch: int = 64
    rate: float = 0.2
    decay: float = 1e-5
    least_z: float = 2.5
    seed: int = 7


def term_sets(raw: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each distinct term of each row, sorted by row."""
    a = np.frombuffer(raw.tobytes().translate(_LOWER), np.uint8)
    start, end, row = word_spans(_LETTERS[a], off)
    row = row.astype(np.uint64)
    keys = []
    for k, width in enumerate((None, 5, 4)):
        h = hash_words(a, start, end if width is None else np.minimum(end, start + width))
        bucket = ((h ^ np.uint64(k * 0x5851F42D4C957F2D)) * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - bits)
        keys.append((row << np.uint64(bits)) | bucket)
    key = np.sort(np.concatenate(keys))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    bits: int

    def raw_scores(self, row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
        out = np.full(rows, self.bias)
        if len(row):
            v = self.factors[bucket]
            at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            s = np.add.reduceat(v, at, axis=0)
            q = np.add.reduceat((v * v).sum(1), at)
            out[row[at]] += np.add.reduceat(self.linear[bucket], at) + 0.5 * ((s * s).sum(1) - q)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(sets: list[np.ndarray], labels: np.ndarray, share: float, s: Settings) -> Model:
    """Fit on sets of buckets; ``share`` is the true share of class 1 among all labelled rows."""
    size = 1 << s.bits
    linear, factors = np.zeros(size, np.float32), np.zeros((size, s.factors), np.float32)
    prior = float(np.log(share / (1 - share)))
    positives = labels.sum()
    if not 0 < positives < len(labels):
        return Model(prior, linear, factors, s.bits)
    counts = [np.bincount(np.concatenate([x for x, y in zip(sets, labels) if y == c] or [np.zeros(0, np.int32)]), minlength=size) + 0.5 for c in (0, 1)]
    odds = np.log(counts[1] / (positives + 1)) - np.log(counts[0] / (len(labels) - positives + 1))
    seen = np.abs(odds) >= s.least_z * np.sqrt(1 / counts[0] + 1 / counts[1])  # terms that tell the classes apart
    rng = np.random.default_rng(s.seed)
    own = np.flatnonzero(seen)
    factors[own] = rng.normal(0, 0.01, (len(own), s.factors)).astype(np.float32)
    sets = [x[seen[x]] for x in sets]
    offset = float(np.log(positives / (len(labels) - positives)))
    bias, g_bias, g_lin, g_fac = offset, 1e-8, np.full(size, 1e-2, np.float32), np.full((size, s.factors), 1e-2, np.float32)
    for _ in range(s.epochs):
        order = rng.permutation(len(sets))
        for i in range(0, len(order), s.batch):
            part = order[i : i + s.batch]
            lens = np.array([len(sets[k]) for k in part])
            idx = np.concatenate([sets[k] for k in part])
            doc = np.repeat(np.arange(len(part)), lens)
            v, w = factors[idx], linear[idx]
            total = np.stack([np.bincount(doc, v[:, f], len(part)) for f in range(s.factors)], 1).astype(np.float32)
            pair = 0.5 * ((total * total).sum(1) - np.bincount(doc, (v * v).sum(1), len(part)))
            p = sigmoid(bias + np.bincount(doc, w, len(part)) + pair)
            err = (p - labels[part]).astype(np.float32)
            e = err[doc]
            uniq, inv = np.unique(idx, return_inverse=True)
            gl = np.bincount(inv, e, len(uniq)).astype(np.float32) + s.decay * len(part) * linear[uniq]
            d = e[:, None] * (total[doc] - v)
            gv = np.stack([np.bincount(inv, d[:, f], len(uniq)) for f in range(s.factors)], 1).astype(np.float32) + s.decay * len(part) * factors[uniq]
            g_lin[uniq] += gl * gl
            g_fac[uniq] += gv * gv
            linear[uniq] -= s.rate * gl / np.sqrt(g_lin[uniq])
            factors[uniq] -= 0.1 * s.rate * gv / np.sqrt(g_fac[uniq])
            gb = float(err.sum())
            g_bias += gb * gb
            bias -= s.rate * gb / g_bias**0.5
    return Model(bias - offset + prior, linear, factors, s.bits)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Fit on the rows of ``labels`` (doc_id, toxic) that have a document."""
    s = settings or Settings()
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y"))
    n = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    share = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
    most = 1_000_000
    cut = F.when(F.col("_y") == 1, F.lit(int(most * min(1, s.max_rows / max(1, n.get(1, 0)))))).otherwise(F.lit(int(most * min(1, s.max_rows / max(1, n.get(0, 0))))))
    sample = known.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(s.seed)), F.lit(most)) < cut)
    rows = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(sample), "doc_id").select("doc_id", "_text", "_y")  # at most about 2 * max_rows ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw_all, off_all = utf8(b.column("_text"))
            sets = []
            for i, j in pieces(off_all, 2 << 20):
                row, bucket = term_sets(raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i], s.bits)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                sets += [bucket[cut[k] : cut[k + 1]].astype(np.int32).tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_y"), pa.array(sets, pa.binary())], names=["doc_id", "_y", "_set"])

    got = lean(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, _y int, _set binary").toPandas().sort_values("doc_id", kind="stable")
    if not len(got):
        return train([], np.zeros(0), share, s)
    model = train([np.frombuffer(x, np.int32) for x in got["_set"]], got["_y"].to_numpy(np.float64), share, s)
    del got
    release()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score``, the probability of label 1."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "_text")]
    d = docs.select(*keep, F.col(text).alias("_text"))
    schema = with_fields(d, "score double", "_text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            raw_all, off_all = utf8(b.column("_text"))
            out = [np.zeros(0)]
            for i, j in pieces(off_all, 2 << 20):
                row, bucket = term_sets(raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i], m.bits)
                out.append(sigmoid(m.raw_scores(row, bucket, j - i)))
            yield pa.RecordBatch.from_arrays([*b.drop_columns(["_text"]).columns, pa.array(np.concatenate(out), pa.float64())], names=[*keep, "score"])

    return lean(d, run, schema)
