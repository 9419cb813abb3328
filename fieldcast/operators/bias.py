"""Outliers, skew and class balance of tabular records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clip
from .ranks import quantiles


def iqr_bounds(df: DataFrame, column: str, factor: float = 1.5, approx: bool = False) -> DataFrame:
    """One row: q1, q3, lower, upper, outliers (strictly outside). Exact quartiles take a sort of the distinct values in parts."""
    shares = [0.25, 0.75]
    q = df.agg(F.percentile_approx(column, F.array(*map(F.lit, shares)), 100_000).alias("_q")) if approx else quantiles(df, [], column, shares)
    q = q.select(F.col("_q")[0].cast("double").alias("q1"), F.col("_q")[1].cast("double").alias("q3"))
    q = q.withColumns({"lower": F.col("q1") - factor * (F.col("q3") - F.col("q1")), "upper": F.col("q3") + factor * (F.col("q3") - F.col("q1"))})
    d = df.select(column).crossJoin(F.broadcast(q))  # one row
    return d.groupBy("q1", "q3", "lower", "upper").agg(F.count(F.when((F.col(column) < F.col("lower")) | (F.col(column) > F.col("upper")), 1)).alias("outliers"))


def box_cox_all(df: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, float]]:
    """{column: (lambda, shift)} of greatest profile likelihood. Each search pass is one aggregation for all columns together.

    Values are shifted to be positive if any isn't. A constant or empty column has lambda None.
    """
    if not columns:
        return {}
    row = df.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max), ("n", F.count)))).first()
    shift = {c: 0.0 if row[f"low{i}"] is None or row[f"low{i}"] > 0 else abs(float(row[f"low{i}"])) + 1e-6 for i, c in enumerate(columns)}
    open_ = [c for i, c in enumerate(columns) if row[f"n{i}"] > 1 and row[f"low{i}"] != row[f"high{i}"]]
    found: dict[str, float] = {}
    if open_:
        centers = df.agg(*(F.avg(F.ln(F.col(c) + shift[c])) for c in open_)).first()
        logs = {c: F.ln(F.col(c) + shift[c]) - m for c, m in zip(open_, centers)}  # around 0, so that powers stay near 1

        def spreads(lambdas: dict[str, list[float]]) -> dict[str, list[float]]:
            wanted = [F.var_pop(logs[c] if abs(k) < 1e-12 else F.exp(k * logs[c]) / k) for c, ks in lambdas.items() for k in ks]
            got = iter(df.agg(*(v.alias(f"v{i}") for i, v in enumerate(wanted))).first())
            return {c: [math.inf if v is None or v != v or v <= 0 else v for v in (next(got) for _ in ks)] for c, ks in lambdas.items()}

        ends = {c: (-2.0, 2.0) for c in open_}
        while ends:
            grids = {c: [a + (b - a) * i / 16 for i in range(17)] for c, (a, b) in ends.items()}
            tried, after = spreads(grids), {}
            for c, (a, b) in ends.items():
                best = min(range(17), key=tried[c].__getitem__)
                step = (b - a) / 16
                if best in (0, 16) and b - a < 1e3:
                    after[c] = (a - 2 * (b - a), b) if best == 0 else (a, b + 2 * (b - a))
                elif step < 1e-3:
                    found[c] = grids[c][best]
                else:
                    after[c] = (grids[c][best] - step, grids[c][best] + step)
            ends = after
        step = 1e-3
        last = spreads({c: [k - step, k, k + step] for c, k in found.items()})
        for c, v in last.items():
            x, y, z = map(math.log, v)
            if x - 2 * y + z > 0:
                found[c] += 0.5 * step * (x - z) / (x - 2 * y + z)
    return {c: (found.get(c), shift[c]) for c in columns}


def _powered(column: str, k: float | None, shift: float) -> Column:
    x = F.col(column) + shift
    return F.col(column).cast("double") if k is None else F.ln(x) if abs(k) < 1e-8 else (F.pow(x, F.lit(k)) - 1) / k


def box_cox(df: DataFrame, column: str, name: str | None = None) -> tuple[DataFrame, float | None, float]:
    """(table, lambda, shift) of one column; a constant or empty one stays as it is."""
    k, shift = box_cox_all(df, [column])[column]
    return df.withColumn(name or column, _powered(column, k, shift)), k, shift


def correct_bias(df: DataFrame, columns: list[str], fix_skew: bool = True, factor: float = 1.5) -> DataFrame:
    """Clip each column to its bounds, then correct its skew."""
    bounds = {c: iqr_bounds(df, c, factor).first() for c in columns}
    df = df.withColumns({c: clip(F.col(c), F.lit(r["lower"]), F.lit(r["upper"])) for c, r in bounds.items() if r is not None and r["lower"] is not None})
    if fix_skew:
        fits = box_cox_all(df, [c for c, r in bounds.items() if r is not None and r["lower"] is not None])
        df = df.withColumns({c: _powered(c, k, shift) for c, (k, shift) in fits.items()})
    return df


CLASSES = 1000


def _hash(seed: int, *values) -> Column:
    """60 bits of the MD5 of the values' text, which any engine can work out."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(v).cast("string"), F.lit("")) if isinstance(v, str) else v.cast("string") for v in values))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def balance_classes(df: DataFrame, target: str, order: list[str], seed: int = 42, part_rows: int = 100_000) -> DataFrame:
    """Oversample each smaller class with replacement up to the largest; originals stay, the NULL class isn't touched.

    Draw i of a class takes the row at place hash(seed, class, i) mod size. Rows are numbered within class and hash part, with
    the parts' sizes before as offset, so no class is numbered in one task (within a part by ``order``); draws are made
    by ranges and meet rows by (class, place).
    """
    some = df.filter(F.col(target).isNotNull())
    counts = [(r[target], r["_n"]) for r in some.groupBy(target).agg(F.count(F.lit(1)).alias("_n")).orderBy(target).limit(CLASSES + 1).collect()]
    if len(counts) > CLASSES:
        raise ValueError(f"{target} has over {CLASSES} classes")
    most = max((n for _, n in counts), default=0)
    if not any(n < most for _, n in counts):
        return df
    parts = max(1, most // part_rows)
    rows = some.withColumn("_p", _hash(seed, *order) % parts)
    size = rows.groupBy(F.col(target).alias("_t"), F.col("_p").alias("_q")).agg(F.count(F.lit(1)).alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy("_t").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = size.select("_t", "_q", before.alias("_before"))
    rows = rows.join(offsets, (F.col(target) == F.col("_t")) & (F.col("_p") == F.col("_q")))
    rows = rows.withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy("_t", "_p").orderBy(*order)) - 1)
    spark, draws = df.sparkSession, None
    for value, n in counts:
        if n < most:
            one = spark.range(most - n).select(F.lit(value).cast(df.schema[target].dataType).alias("_c"), F.col("id").alias("_d"))
            one = one.select("_c", (_hash(seed, "_c", "_d") % n).alias("_pick"))
            draws = one if draws is None else draws.unionByName(one)
    more = draws.join(rows, (F.col("_c") == F.col("_t")) & (F.col("_pick") == F.col("_i"))).select(*df.columns)
    return df.unionByName(more)


def split(df: DataFrame, ids: list[str], train_fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``is_train``: exactly int(n * fraction) rows, those of the least hashes; the cut is found by counts of hash prefixes."""
    d = df.withColumn("_h", _hash(seed, *ids))
    want, base, bits, scope = int(df.count() * train_fraction), 0, 60, d
    while bits > 0:
        low = max(0, bits - 12)
        n = {r["p"]: r["c"] for r in scope.groupBy(F.shiftright("_h", low).alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}  # at most 4096 rows
        here = None
        for p in sorted(n):
            if want < n[p]:
                here = p
                break
            want -= n[p]
        if here is None:
            return d.withColumn("is_train", F.lit(True)).drop("_h") if not bits < 60 else d.withColumn("is_train", F.col("_h") < ((base + 1) << bits)).drop("_h")
        base, bits = here, low
        scope = scope.filter(F.shiftright("_h", low) == here)
        if want == 0:
            return d.withColumn("is_train", F.col("_h") < (base << bits)).drop("_h")
    ties = d.filter(F.col("_h") == base).withColumn("_r", F.row_number().over(Window.partitionBy("_h").orderBy(*ids)))
    rest = d.filter(F.col("_h") != base).withColumn("is_train", F.col("_h") < base)
    return rest.unionByName(ties.withColumn("is_train", F.col("_r") <= want).drop("_r")).drop("_h")
