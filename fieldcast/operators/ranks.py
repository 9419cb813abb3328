"""Exact ranks and quantiles of whole columns, in parts of even size with offsets, so no group is one task or one list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cumulative(df: DataFrame, key: list[str], column: str, counts: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Distinct values of each key with running counts: key, ``_x``, and for each name of ``counts`` (aggregations) its count
    and, as ``_upto_{name}``, the sum over this and all smaller values of the key.

    Equal values are counted first. Each key's values are cut at approximate quantiles of its distinct values, whatever their
    spread; there is about one part for each 100,000 of them.
    """
    d = df.filter(F.col(column).isNotNull()).groupBy(*key, F.col(column).cast("double").alias("_x")).agg(*(v.alias(k) for k, v in counts.items()))
    if parts is None:
        parts = min(1000, max(1, d.count() // 100_000))
    d = d.withColumn("_one", F.lit(0))  # stands for the key where there is none
    by = [*key, "_one"]
    if parts > 1:
        shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
        cuts = d.groupBy(*by).agg(F.percentile_approx("_x", shares, 10 * parts).alias("_cuts"))  # a row of at most 1000 cuts for each key
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(parts.bit_length()))))
        at = F.aggregate(steps, F.lit(0), lambda at, k: F.when(F.get("_cuts", at + k - 1) <= F.col("_x"), at + k).otherwise(at))
        d = d.join(cuts, by).withColumn("_part", at).drop("_cuts")
    else:
        d = d.withColumn("_part", F.lit(0))
    sums = d.groupBy(*by, "_part").agg(*(F.sum(k).alias(f"_s_{k}") for k in counts))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, "_part", *(F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in counts))
    own = Window.partitionBy(*by, "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(base, [*by, "_part"])
    return out.select(*key, "_x", *counts, *((F.col(f"_b_{k}") + F.sum(k).over(own)).alias(f"_upto_{k}") for k in counts))


def quantiles(df: DataFrame, key: list[str], column: str, shares: list[float], parts: int | None = None) -> DataFrame:
    """key, ``_q``: exact quantiles with linear interpolation, as an array. Keys without a value have no row; without a key
    there is always one row, of NULLs if there is no value."""
    d = cumulative(df, key, column, {"_n": F.count(F.lit(1))}, parts)
    total = df.filter(F.col(column).isNotNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("_total"))
    d = d.join(total, key) if key else d.crossJoin(F.broadcast(total))
    at = [(F.col("_total") - 1) * q for q in shares]
    places = [p for x in at for p in (F.floor(x), F.ceil(x))]
    first, last = F.col("_upto__n") - F.col("_n"), F.col("_upto__n") - 1
    hit = reduce(lambda a, b: a | b, ((p >= first) & (p <= last) for p in places))
    found = d.filter(hit).groupBy(*key).agg(F.max("_total").alias("_total"), *(F.max(F.when((p >= first) & (p <= last), F.col("_x"))).alias(f"_p{i}") for i, p in enumerate(places)))
    ends = [(F.col(f"_p{2 * i}"), F.col(f"_p{2 * i + 1}"), x - F.floor(x)) for i, x in enumerate(at)]
    return found.select(*key, F.array(*(a + (b - a) * w for a, b, w in ends)).alias("_q"))
