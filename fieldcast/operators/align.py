"""Joins in space and time: nearest cell, as-of windows, regridding, day intersection, attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import in_bbox
from .ranges import HOT_ROWS, by_parts


def nearest_on_axis(points: DataFrame, axis: DataFrame, key: list[str], point: str, coord: str, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Nearest axis value of each point within its key; of two equally near the larger. NULL points or keys have none.

    Points and distinct axis values are sorted together; a point takes the last axis value before it or the next one after it,
    so work is linear in both, and hot keys are cut into ranges.
    """
    a = axis.select(*key, F.col(coord).cast("double").alias("_a")).filter("_a IS NOT NULL").dropna(subset=key).distinct()
    own = points.withColumn("_x", F.col(point).cast("double")).withColumn("_kind", F.lit(1))
    both = own.unionByName(a.withColumn("_x", F.col("_a")).withColumn("_kind", F.lit(0)), allowMissingColumns=True)

    def run(d: DataFrame, by: list[str]) -> DataFrame:
        near = F.last("_a", ignorenulls=True)
        below = near.over(Window.partitionBy(*by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
        above = near.over(Window.partitionBy(*by).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0))
        return d.withColumns({"_lo": below, "_hi": above})

    d = by_parts(both, key, ["_x", "_kind"], run, ends=["_a"], hot_rows=hot_rows).filter("_kind = 1")
    lo, hi, x = F.col("_lo"), F.col("_hi"), F.col("_x")
    best = F.when(x.isNull(), None).when(lo.isNull() | (hi - x <= x - lo), hi).otherwise(lo)
    return d.withColumn(name, F.coalesce(best, F.when(x.isNotNull(), lo))).select(*points.columns, name)


def nearest_cell(points: DataFrame, grid: DataFrame, key: list[str] = ["site"], lat: str = "lat", lon: str = "lon", hot_rows: int = HOT_ROWS) -> DataFrame:  # noqa: B006
    """Adds cell_lat and cell_lon: each axis on its own, without a greatest distance."""
    out = nearest_on_axis(points, grid, key, lat, lat, "cell_lat", hot_rows)
    return nearest_on_axis(out, grid, key, lon, lon, "cell_lon", hot_rows)


FINE = 2  # a tile's side is between a quarter and a half of the box's
MOST_LEVELS = 1000


def in_boxes(points: DataFrame, boxes: DataFrame, key: list[str], lat: str, lon: str, box: str, hot_points: int = 1_000_000) -> DataFrame:
    """Inner join of points with the boxes (min_lon, min_lat, max_lon, max_lat, ends included) of their key that hold them.

    A spatial hash join: each side of a box fixes the side of its tiles, a power of two, so a box lies on at most six tiles an
    axis, whatever its size; points are hashed once for each pair of sides that occurs. A tile with more than ``hot_points``
    points is dealt by salts, with its boxes beside each. The columns of both tables must differ, but for ``key``.
    """
    b = boxes.dropna(subset=[*key, box]).filter((F.col(box)[0] <= F.col(box)[2]) & (F.col(box)[1] <= F.col(box)[3]))
    level = lambda lo, hi: F.when(hi > lo, F.floor(F.log2(hi - lo)) - FINE + 1).otherwise(F.lit(0)).cast("int")
    b = b.withColumn("_u", level(F.col(box)[0], F.col(box)[2])).withColumn("_w", level(F.col(box)[1], F.col(box)[3]))
    levels = [(r["_u"], r["_w"]) for r in b.select("_u", "_w").distinct().limit(MOST_LEVELS + 1).collect()]  # a pair for each two orders of magnitude
    if len(levels) > MOST_LEVELS:
        raise ValueError("boxes of too many sizes; scale the coordinates")
    tile = lambda x, k: F.floor(x / F.pow(F.lit(2.0), k)).cast("long")
    p = points.dropna(subset=[*key, lat, lon])
    sides = F.array(*(F.struct(F.lit(u).alias("_u"), F.lit(w).alias("_w")) for u, w in levels)) if levels else F.array().cast("array<struct<_u:int,_w:int>>")
    p = p.withColumn("_s", F.explode(sides)).select("*", "_s.*").drop("_s")
    p = p.withColumns({"_tx": tile(F.col(lon), F.col("_u")), "_ty": tile(F.col(lat), F.col("_w"))})
    span = lambda lo, hi, k: F.explode(F.sequence(tile(F.col(box)[lo], F.col(k)), tile(F.col(box)[hi], F.col(k))))
    b = b.withColumn("_tx", span(0, 2, "_u")).withColumn("_ty", span(1, 3, "_w"))
    at = [*key, "_u", "_w", "_tx", "_ty"]
    hot = p.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / hot_points).cast("int").alias("_n")).filter("_n > 1")
    few = hot.limit(100_001).count()
    if few:
        hot = F.broadcast(hot) if few <= 100_000 else hot
        p = p.join(hot, at, "left").withColumn("_salt", F.pmod(F.xxhash64(lat, lon, F.monotonically_increasing_id()), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
        b = b.join(hot, at, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
        at = [*at, "_salt"]
    found = p.join(b, at).filter(in_bbox(F.col(lat), F.col(lon), F.col(box)))
    return found.drop("_u", "_w", "_tx", "_ty", "_salt")


def history_windows(labels: DataFrame, history: DataFrame, on: list[str], label_id: list[str], label_time: str, time: str, values: list[str], ties: list[str], window: int = 12, fallback: str = "first") -> DataFrame:
    """The last ``window`` history rows up to each label's time (inclusive), as a matrix.

    With fewer: the first ``window`` rows of the history if ``fallback`` is "first" (even if they are later), else no row.
    ``window_source`` says which. Labels whose whole history is shorter have no row; history without a time isn't used.
    History is numbered once for each key; a label takes its rows by number, so work is labels times ``window``.
    """
    h = history.filter(F.col(time).isNotNull()).select(*on, F.col(time).alias("_t"), *ties, F.array(*(F.col(v).cast("double") for v in values)).alias("_v"))
    h = h.withColumn("_asc", F.row_number().over(Window.partitionBy(*on).orderBy("_t", *ties)))
    size = h.groupBy(*on).agg(F.count(F.lit(1)).alias("_all"))
    own = labels.select(*on, F.col(label_time).alias("_t"), F.struct(*label_id).alias("_id"), F.lit(1).alias("_k")).dropDuplicates()
    both = h.select(*on, "_t", F.lit(0).alias("_k")).unionByName(own, allowMissingColumns=True)
    upto = Window.partitionBy(*on).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)  # history comes before a label of its time
    at = both.withColumn("_past", F.count(F.when(F.col("_k") == 0, 1)).over(upto)).filter("_k = 1").join(size, on).filter(F.col("_all") >= window)
    enough = F.col("_past") >= window
    if fallback == "drop":
        at = at.filter(enough)
    first = F.when(enough, F.col("_past") - window + 1).otherwise(F.lit(1))
    at = at.select(*on, "_id", F.when(enough, "recent").otherwise("first").alias("window_source"), F.explode(F.sequence(first, first + window - 1)).alias("_asc"))
    matrix = F.transform(F.array_sort(F.collect_list(F.struct("_asc", "_v"))), lambda x: x["_v"])
    out = at.join(h.select(*on, "_asc", "_v"), [*on, "_asc"]).groupBy("_id").agg(matrix.alias("window"), F.max("window_source").alias("window_source"))
    return labels.join(out.select("_id.*", "window", "window_source"), label_id)


def common_days(a: DataFrame, b: DataFrame, key: list[str], day: str = "day") -> tuple[DataFrame, DataFrame]:
    days = a.select(*key, day).intersect(b.select(*key, day))
    return a.join(days, [*key, day], "left_semi"), b.join(days, [*key, day], "left_semi")


def bilinear_weights(fine: DataFrame, coarse: DataFrame, key: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """key, lat, lon of the fine cells; c_lat, c_lon, w of up to four coarse corners; inside the coarse grid only."""

    def axis(c: str) -> DataFrame:
        own = coarse.select(*key, F.col(c).alias("_a")).distinct()
        w = Window.partitionBy(*key).orderBy("_a")
        steps = own.withColumn("_b", F.coalesce(F.lead("_a").over(w), F.col("_a"))).withColumn("_last", F.lead("_a").over(w).isNull())
        x = fine.select(*key, F.col(c).alias(c)).distinct()
        hit = x.join(steps, key).filter((F.col(c) >= F.col("_a")) & ((F.col(c) < F.col("_b")) | (F.col("_last") & (F.col(c) == F.col("_a")))))
        share = F.coalesce(F.try_divide(F.col(c) - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0))
        ends = F.array(F.struct(F.col("_a").alias("c"), (1 - share).alias("w")), F.struct(F.col("_b").alias("c"), share.alias("w")))
        return hit.select(*key, c, F.explode(ends).alias("_e")).filter("_e.w > 0").select(*key, c, F.col("_e.c").alias(f"c_{c}"), F.col("_e.w").alias(f"w_{c}"))

    cells = fine.select(*key, lat, lon).distinct()
    out = cells.join(axis(lat), [*key, lat]).join(axis(lon), [*key, lon])
    return out.select(*key, lat, lon, f"c_{lat}", f"c_{lon}", (F.col(f"w_{lat}") * F.col(f"w_{lon}")).alias("w"))


def regrid(coarse: DataFrame, fine: DataFrame, key: list[str], day: str, values: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Bilinear values of a coarse grid on the fine cells, for every day; outside it or with a NULL corner 0."""
    weights = bilinear_weights(fine, coarse, key, lat, lon)
    c = coarse.select(*key, day, F.col(lat).alias(f"c_{lat}"), F.col(lon).alias(f"c_{lon}"), *values)
    parts = weights.join(c, [*key, f"c_{lat}", f"c_{lon}"])
    out = parts.groupBy(*key, day, lat, lon).agg(*(F.when(F.abs(F.sum(F.when(F.col(v).isNotNull(), F.col("w"))) - 1) < 1e-9, F.sum(F.col("w") * F.col(v))).alias(v) for v in values))
    days = coarse.select(*key, day).distinct()
    every = fine.select(*key, lat, lon).distinct().join(days, key)
    return every.join(out, [*key, day, lat, lon], "left").withColumns({v: F.coalesce(v, F.lit(0.0)) for v in values})


def attach(df: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Labels (inner) or soil (left) by key; Spark broadcasts the table if it is small."""
    return df.join(table, on, how)


def stack_features(satellite: DataFrame, weather: DataFrame, on: list[str], sat: list[str], wea: list[str]) -> DataFrame:
    """One ``features`` array per timestep: satellite first, then weather."""
    return satellite.join(weather, on).select(*on, F.array(*(F.col(c).cast("double") for c in [*sat, *wea])).alias("features"))


def split_features(df: DataFrame, width: int, column: str = "features") -> DataFrame:
    """Undo ``stack_features`` on a matrix column."""
    c = F.col(column)
    return df.withColumns({"sat": F.transform(c, lambda r: F.slice(r, 1, width)), "weather": F.transform(c, lambda r: F.slice(r, width + 1, 1 << 20))})


def match_reference(current: DataFrame, reference: DataFrame, region: str) -> DataFrame:
    """Regions of the current side; ``reference_missing`` where the reference has none (it is then its own reference)."""
    r = reference.select(region).distinct().withColumn("_there", F.lit(True))
    return current.select(region).distinct().join(r, region, "left").select(region, F.col("_there").isNull().alias("reference_missing"))


def missing_sites(sites: DataFrame, *stores: DataFrame, on: list[str]) -> DataFrame:
    """Sites that one of the stores lacks."""
    both = sites.select(*on).distinct()
    have = both
    for s in stores:
        have = have.join(s, on, "left_semi")
    return both.join(have, on, "left_anti")
