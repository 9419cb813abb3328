"""Scoring with a user's vectorized model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
MODALITIES = ("Satellite", "Weather", "Soil")
_RANKS = (2, 2, 1)
_KEPT: dict[str, Scorer] = {}  # the model of a Python worker, from one task to the next


def _model(load: Callable[[], Scorer], digest: str) -> Scorer:
    if digest not in _KEPT:
        _KEPT.clear()
        _KEPT[digest] = load()
    return _KEPT[digest]


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def shapes(column: pa.Array, rank: int) -> np.ndarray:
    """Per row the lengths of a nested list, 0 where it is NULL, empty or ragged."""
    own = np.maximum(_sizes(column), 0)
    if rank == 1:
        return own[:, None]
    inner, wide = _sizes(column.flatten()), np.zeros(len(own), np.int64)
    some = np.flatnonzero(own)
    if len(some):
        at = (np.cumsum(own) - own)[some]
        low, high = np.minimum.reduceat(inner, at), np.maximum.reduceat(inner, at)
        wide[some] = np.where(low == high, np.maximum(low, 0), 0)
    return np.stack([own, wide], 1)


def tensor(column: pa.Array, shape: tuple[int, ...]) -> np.ndarray:
    """The rows of a nested list of one shape as an array, from its flat buffer; a NULL cell is NaN."""
    for _ in shape:
        column = column.flatten()
    return column.to_numpy(zero_copy_only=False).astype(float).reshape(-1, *shape)


def _rows(values: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """A list column with these rows at these places, NULL elsewhere."""
    there = np.zeros(n, bool)
    there[at] = True
    ends = np.concatenate([[0], np.cumsum(np.where(there, values.shape[1] if len(at) else 0, 0))])
    order = np.argsort(at, kind="stable")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[order].astype(float).ravel()), mask=pa.array(~there))


def feature_means(df: DataFrame, sat: str = "sat", weather: str = "weather", soil: str = "soil") -> tuple[np.ndarray, ...]:
    """Mean of each feature of the three inputs over all rows and steps: a few numbers, one for each feature."""
    out = []
    for name, rank in zip((sat, weather, soil), _RANKS):
        d = df.select(F.explode(name).alias("_r")) if rank == 2 else df.select(F.col(name).alias("_r"))
        means = d.select(F.posexplode("_r").alias("_i", "_x")).groupBy("_i").agg(F.avg("_x").alias("m")).orderBy("_i").collect()
        out.append(np.array([0.0 if r["m"] is None else r["m"] for r in means]))
    return tuple(out)


def _shares(model: Scorer, x: list[np.ndarray], base: tuple[np.ndarray, ...]) -> np.ndarray:
    """How much of a row's estimate each modality moves against its mean, as shares that add up to 1 (or are all 0)."""
    estimate = lambda *a: (lambda r: (np.asarray(r[0]) * np.asarray(r[2])).sum(1))(model(*a))
    here = estimate(*x)
    moved = np.stack([np.abs(here - estimate(*(np.broadcast_to(base[k], x[k].shape) if k == m else x[k] for k in range(3)))) for m in range(3)], 1)
    total = moved.sum(1, keepdims=True)
    return np.divide(moved, total, out=np.zeros_like(moved), where=total > 0)


def score(df: DataFrame, load: Callable[[], Scorer], sat: str = "sat", weather: str = "weather", soil: str = "soil", batch: int = 1024, means: tuple[np.ndarray, ...] | None = None) -> DataFrame:
    """Add pi, sigma, mu, and with ``means`` (``feature_means``) ``shares`` of the modalities.

    ``load`` runs once per Python worker and gives (sat[B,T,C], weather[B,T,F], soil[B,S]) -> (pi, sigma, mu)[B,K]. Tensors are the
    list columns' own buffers, rows of equal shapes together. Rows with a NULL, empty or ragged input aren't scored: NULL.
    """
    added = ["pi", "sigma", "mu"] + (["shares"] if means is not None else [])
    own = [c for c in df.columns if c not in added]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c in own) + "".join(f", {c} array<double>" for c in added)
    digest = hashlib.sha256(cloudpickle.dumps(load)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(load, digest)
        for b in batches:
            inputs = [b.column(b.schema.get_field_index(c)) for c in (sat, weather, soil)]
            shape = np.concatenate([shapes(x, rank) for x, rank in zip(inputs, _RANKS)], 1)
            at, found = [np.zeros(0, np.int64)], [[] for _ in added]
            for one in np.unique(shape[(shape > 0).all(1)], axis=0):
                same = np.flatnonzero((shape == one).all(1))
                for i in range(0, len(same), batch):
                    rows = same[i : i + batch]
                    x = [tensor(c.take(pa.array(rows)), s) for c, s in zip(inputs, (tuple(one[:2]), tuple(one[2:4]), tuple(one[4:])))]
                    got = list(model(*x)[:3]) + ([_shares(model, x, means)] if means is not None else [])
                    at.append(rows)
                    for held, v in zip(found, got):
                        held.append(np.asarray(v, float))
            at = np.concatenate(at)
            new = [_rows(np.concatenate(v) if v else np.zeros((0, 0)), at, b.num_rows) for v in found]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in own), *new], names=[*own, *added])

    return df.select(*own).mapInArrow(run, schema)


def stand_in_scorer() -> Scorer:
    """A deterministic model for tests: three components around simple means of the inputs."""

    def model(sat: np.ndarray, weather: np.ndarray, soil: np.ndarray):
        s, w, g = sat.mean((1, 2)), weather.mean((1, 2)), soil.mean(1)
        z = np.stack([s, w / 100, g / 10], 1)
        e = np.exp(z - z.max(1, keepdims=True))
        mu = 3 + np.stack([np.tanh(s), np.tanh(w / 50), np.tanh(g / 5)], 1)
        return e / e.sum(1, keepdims=True), 0.2 + 0.1 * np.abs(np.tanh(z)), mu

    return model
