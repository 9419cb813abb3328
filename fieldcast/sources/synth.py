"""Synthetic tables at any scale: hashed uniforms, so every row can be made anywhere and again."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: str, *key: Column) -> Column:
    """In (0, 1): 52 bits of the MD5 of the seed and the key's text, which any engine can work out."""
    text = F.concat_ws(":", F.lit(seed), *(k.cast("string") for k in key))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def normal(seed: str, *key: Column) -> Column:
    return F.sqrt(-2 * F.ln(uniform(seed + "r", *key))) * F.cos(2 * math.pi * uniform(seed + "a", *key))


def sites(spark: SparkSession, n: int, with_grid: int | None = None) -> DataFrame:
    d = spark.range(n).select(F.concat(F.lit("site-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("site"), (20 + F.pmod("id", F.lit(15))).cast("double").alias("lat"), (75 + F.pmod(F.floor(F.col("id") / 15), F.lit(15))).cast("double").alias("lon"), "id")
    box = F.array(F.col("lon") - 0.25, F.col("lat") - 0.25, F.col("lon") + 0.25, F.col("lat") + 0.25)
    return d.select("site", "lat", "lon", F.when(F.col("id") < (n if with_grid is None else with_grid), box).alias("bbox"))


def yields(areas: DataFrame, first: int = 2018, last: int = 2024) -> DataFrame:
    d = areas.withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    c = F.col
    return d.select("lat", "lon", F.make_timestamp(c("year"), F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0)).alias("time"), (3.5 + 0.5 * normal("yield", c("site"), c("year"))).alias("yield"), c("site").alias("site_id"), "year")


def _grid(areas: DataFrame, n: int, start: str, end: str, step: str) -> DataFrame:
    axis = lambda a, b: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: a + (b - a) * i / (n - 1))
    box = F.col("bbox")
    d = areas.filter("bbox IS NOT NULL").withColumn("time", F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"interval {step}"))))
    d = d.select("site", "time", F.explode(axis(box[1], box[3])).alias("lat"), box.alias("b"))
    return d.select("site", "time", "lat", F.explode(axis(F.col("b")[0], F.col("b")[2])).alias("lon"))


def satellite(areas: DataFrame, start: str, end: str, n: int = 10) -> DataFrame:
    g = _grid(areas, n, start, end, "15 days")
    k = [F.col(c) for c in ("site", "time", "lat", "lon")]
    band = lambda name, a, b: (a + (b - a) * uniform(name, *k)).alias(name)
    scene = F.array(*map(F.lit, (4, 5, 6, 8, 9)))[F.floor(uniform("SCL", *k) * 5).cast("int")]
    return g.select("*", band("B02", 0.01, 0.1), band("B03", 0.01, 0.1), band("B04", 0.01, 0.1), band("B08", 0.2, 0.6), scene.alias("SCL"))


def weather(areas: DataFrame, start: str, end: str, n: int = 5) -> DataFrame:
    g = _grid(areas, n, start, end, "1 day")
    k = [F.col(c) for c in ("site", "time", "lat", "lon")]
    return g.select("*", (30 + 5 * normal("t_max", *k)).alias("t_max"), (20 + 5 * normal("t_min", *k)).alias("t_min"), (-5 * F.ln(uniform("precip", *k))).alias("precip"))


def soil(areas: DataFrame) -> DataFrame:
    s = F.col("site")
    return areas.select("site", (6.5 + 0.1 * normal("ph", s)).alias("ph"), (12.5 + 0.5 * normal("soc", s)).alias("soc"), (4.2 + 0.2 * normal("n", s)).alias("nitrogen"))


def official_statistics(spark: SparkSession, states: list[str], crops: list[str], first: int, last: int) -> DataFrame:
    """year, state, crop, yield (normal around 2.5 with deviation 0.2) for every state, crop and year."""
    d = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"), F.explode(F.array(*map(F.lit, states))).alias("state"))
    d = d.select("year", "state", F.explode(F.array(*map(F.lit, crops))).alias("crop"))
    return d.withColumn("yield", 2.5 + 0.2 * normal("official", F.col("year"), F.col("state"), F.col("crop")))
