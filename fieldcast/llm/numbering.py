"""Consecutive numbers within keys, however many rows one key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

FEW_OFFSETS = 200_000  # of about 50 bytes: 10 MB


def numbered(df: DataFrame, keys: list[str], order: list[str], what: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``pos`` (from 0 within the keys, by ``order``, nulls first), and the number of rows ``size`` of each key.

    Rows are sorted in ranges of (keys, order), so a hot key lies in many tasks; each range's rows of a key are counted, and the
    counts of the ranges before it are its offset. Keys must not be null. The sorted rows are a written table: ranges don't
    move when an executor is lost.
    """
    part = F.spark_partition_id()
    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = written(rows.withColumn("_part", part).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)), what)
    stats = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of the key
    stats = written(stats.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), f"{what}-ranges")
    few = stats.limit(FEW_OFFSETS + 1).count() <= FEW_OFFSETS
    offsets = stats.select(*keys, "_part", (F.col("_before") - F.col("_from")).alias("_shift"))
    out = rows.join(F.broadcast(offsets) if few else offsets, [*keys, "_part"])
    return out.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift"), stats.groupBy(*keys).agg(F.sum("_n").alias("size"))
