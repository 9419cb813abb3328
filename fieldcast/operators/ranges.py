"""Windows along an order for keys of any size: hot keys are cut into sorted ranges that get what they need from their neighbours.

A window parted by key is one task a key. Keys of more than ``hot_rows`` rows are therefore sorted in ranges; each range is
a partition of its own, and synthetic rows before and after it carry what lies outside: running sums, the last or next valid
values, or neighbouring rows (a halo). The window expressions are the same for both; synthetic rows leave afterwards.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.io import scratch

HOT_ROWS = 2_000_000
ROW_BYTES = 16
FEW_KEYS = 100_000
Part = Callable[[DataFrame, list[str]], DataFrame]


def expected_few(df: DataFrame, rows: int) -> bool:
    """Whether Spark expects the table to be smaller than so many rows."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < rows * ROW_BYTES


def split_hot(df: DataFrame, key: list[str], hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of other keys, rows of the keys with more than so many rows, or None without such keys).

    A table that Spark expects to be smaller than so many rows isn't counted for it: both ways give the same results.
    """
    if expected_few(df, hot_rows):
        return df, None
    hot = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows).select(*(F.col(k).alias(f"_hot_{k}") for k in key))
    few = hot.limit(FEW_KEYS + 1).count()
    if not few:
        return df, None
    hot = F.broadcast(hot) if few <= FEW_KEYS else hot
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in key)) if key else F.lit(True)
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def _sorted_ranges(df: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_part`` and ``_i`` (from 1 within the key), and per key and part the rows before it and its own."""
    part = F.spark_partition_id()
    path = scratch(df.sparkSession, "ranges")
    rows = df.repartitionByRange(*key, order[0]).sortWithinPartitions(*key, *order)
    rows.withColumn("_part", part).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    parts = rows.groupBy(*key, "_part").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    path = scratch(df.sparkSession, "parts")
    parts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).write.parquet(path)  # a row for each range of a key
    parts = df.sparkSession.read.parquet(path)
    at = parts.select(*(F.col(k).alias(f"_p_{k}") for k in key), F.col("_part").alias("_pp"), (F.col("_start") - F.col("_from") + 1).alias("_shift"))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_p_{k}")) for k in key), F.col("_part") == F.col("_pp"))
    rows = rows.join(at, same).withColumn("_i", F.col("_at") + F.col("_shift"))
    return rows.drop("_at", "_shift", "_pp", *(f"_p_{k}" for k in key)), parts.select(*key, "_part", "_start", "_n")


def _neighbours(rows: DataFrame, parts: DataFrame, key: list[str], columns: list[str], count: int, valid: str | None, after: bool) -> DataFrame:
    """Synthetic rows: of each part the ``count`` rows of its key before (or after) it, or those with a valid value of a column."""
    own = rows.filter(F.col(valid).isNotNull()) if valid else rows
    near = Window.partitionBy(*key, "_part").orderBy(F.asc("_i") if after else F.desc("_i"))
    packed = F.array_sort(F.collect_list(F.struct("_i", *columns)))  # at most ``count``
    ends = own.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= count).groupBy(*key, "_part").agg(packed.alias("_e"))
    by = Window.partitionBy(*key).orderBy(F.desc("_part") if after else F.asc("_part"))
    together = F.flatten(F.collect_list("_e").over(by.rowsBetween(-(count - 1), 0)))
    sorted_ = F.array_sort(together)
    nearest = ends.withColumn("_e", F.slice(sorted_, 1, count) if after else F.slice(sorted_, F.greatest(F.size(sorted_) - count + 1, F.lit(1)), count))
    every = parts.select(*key, "_part")
    same = reduce(Column.__and__, (every[k].eqNullSafe(nearest[k]) for k in [*key, "_part"]))
    joined = every.join(nearest, same, "left").select(*(every[k] for k in [*key, "_part"]), "_e")
    carried = joined.withColumn("_e", F.last("_e", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    found = carried.select(*key, "_part", F.explode("_e").alias("_e"))
    values = [F.col(f"_e.{c}").alias(c) for c in columns]
    return found.select(*key, "_part", F.col("_e._i").alias("_i"), *values)


def by_parts(df: DataFrame, key: list[str], order: list[str] | str, run: Part, sums: list[str] = (), ends: list[str] = (), valid: int = 1, before: int = 0, after: int = 0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``run(rows, key)`` over all rows, with ``_i`` as their order in the key; ``run`` adds columns by windows parted by its key.

    What the windows need from outside a range: running sums of ``sums``, the ``valid`` nearest values of ``ends`` on both
    sides, ``before`` rows before and ``after`` rows after it.
    """
    order = [order] if isinstance(order, str) else list(order)
    cold, hot = split_hot(df, key, hot_rows)
    numbered = cold.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long"))
    out = run(numbered, key).drop("_i")
    if hot is None:
        return out
    rows, parts = _sorted_ranges(hot, key, order)
    extra = []
    if sums:
        totals = rows.groupBy(*key, "_part").agg(*(F.sum(c).alias(f"_s_{c}") for c in sums))
        earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        start = parts.select(*key, "_part", F.col("_start").alias("_i"))
        same = reduce(Column.__and__, (start[k].eqNullSafe(totals[k]) for k in [*key, "_part"]))
        both = start.join(totals, same).select(*(start[k] for k in [*key, "_part", "_i"]), *(f"_s_{c}" for c in sums))
        extra.append(both.select(*key, "_part", "_i", *(F.sum(f"_s_{c}").over(earlier).alias(c) for c in sums)))
    for c in ends:
        extra += [_neighbours(rows, parts, key, [c, *order], valid, c, side) for side in (False, True)]
    others = [c for c in rows.columns if c not in {*key, "_part", "_i"}]
    if before:
        extra.append(_neighbours(rows, parts, key, others, before, None, False))
    if after:
        extra.append(_neighbours(rows, parts, key, others, after, None, True))
    whole = rows.withColumn("_own", F.lit(True))
    for e in extra:
        casts = {c: e[c].cast(rows.schema[c].dataType) for c in e.columns if c in sums}
        whole = whole.unionByName(e.withColumns(casts).withColumn("_own", F.lit(False)), allowMissingColumns=True)
    done = run(whole, [*key, "_part"]).filter("_own").drop("_own", "_part", "_i")
    return out.unionByName(done.select(*out.columns))
