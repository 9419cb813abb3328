"""Aggregations over tables: soil, site history, maps, correlation, summaries, attributions."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fit_length
from ..schema import numeric_columns
from .ranks import quantiles


def valid_ratio(df: DataFrame, key: list[str], scene: str = "SCL", clear=(4, 5, 6), least: float = 0.1) -> DataFrame:
    out = df.groupBy(*key).agg(F.avg(F.coalesce(F.col(scene).isin(*clear), F.lit(False)).cast("double")).alias("valid_ratio"))
    return out.withColumn("is_unreliable", F.col("valid_ratio") < least)


def z_scores(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Number columns first, as (x - mean) / sample std (0 becomes 1e-10); one row gives NULL. Statistics are one row."""
    columns = columns or numeric_columns(df)
    stats = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"_s_{c}") for c in columns))
    d = df.crossJoin(F.broadcast(stats))
    z = [((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, F.lit(1e-10)).otherwise(F.col(f"_s_{c}"))).alias(c) for c in columns]
    return d.select(*z, *(c for c in df.columns if c not in columns))


def soil_vectors(sites: DataFrame, soil: DataFrame, site: str, values: list[str], dim: int, file: str | None = None) -> DataFrame:
    """Per site a vector of ``dim`` numbers with its source and warnings; missing or non-numeric soil is zeros."""
    s = soil.select(F.col(site).alias("_s"), F.lit(True).alias("_there"), *(F.col(c).cast("double").alias(f"_v_{c}") for c in values), *([F.col(file).alias("_file")] if file else []))
    d = sites.join(s, F.col(site) == F.col("_s"), "left")
    raw = F.array_compact(F.array(*(f"_v_{c}" for c in values)))
    none, empty = F.col("_there").isNull(), F.size(raw) == 0
    name = F.col("_file") if file else F.concat(F.col(site), F.lit("_soil.csv"))
    zero = F.forall(raw, lambda x: x == 0)
    warn = F.when(none, "no soil row").when(empty, "no numeric soil value").when(zero, "all soil values are zero")
    return d.select(
        *sites.columns,
        F.when(none | empty, F.array_repeat(F.lit(0.0), dim)).otherwise(fit_length(raw, dim)).alias("soil"),
        F.when(none, "MISSING → zero-vector").when(empty, "NON-NUMERIC → zero-vector").otherwise(F.concat(F.lit("file:"), name)).alias("soil_source"),
        F.array_compact(F.array(warn)).alias("soil_warnings"),
    )


def soil_precip_interaction(soil: DataFrame, weather: DataFrame, site: str, ph: str = "soil_pH", precip: str = "precip") -> DataFrame:
    """soil_pH times the site's mean precipitation; 0 without precipitation; no column without soil_pH."""
    if ph not in soil.columns:
        return soil
    mean = weather.groupBy(site).agg(F.avg(precip).alias("_p"))
    return soil.join(mean, site, "left").withColumn("ph_precip_interaction", F.coalesce(F.col(ph) * F.col("_p"), F.when(F.col(ph).isNotNull(), 0.0))).drop("_p")


def site_history(yields: DataFrame, site: str, year: str, time: str, value: str) -> DataFrame:
    """Per site and year the observed (last) yield, with the site's average over all years."""
    average = yields.groupBy(site).agg(F.avg(value).alias("historical_avg"))
    observed = yields.groupBy(site, year).agg(F.max_by(value, F.struct(time, value)).alias("observed_yield"))
    return observed.hint("merge").join(average.hint("merge"), site)


def years(yields: DataFrame, year: str, site: str | None = None) -> DataFrame:
    if site is None:
        return yields.select(year).filter(F.col(year).isNotNull()).distinct().orderBy(year)
    return yields.groupBy(site).agg(F.array_sort(F.collect_set(year)).alias("years"))


def yield_trend(yields: DataFrame, site: str, year: str, value: str) -> DataFrame:
    """Each site's harvests by year."""
    return yields.select(site, year, value).orderBy(site, year, value)


def all_sites(tables: list[DataFrame]) -> DataFrame:
    """One table of several sites' tables; columns that a table lacks are NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def scaled_means(df: DataFrame, site: str, value: str) -> DataFrame:
    """Mean per site and its place between the least and the greatest mean (a span of 0.1 at least)."""
    m = df.groupBy(site).agg(F.avg(value).alias("mean_value"))
    ends = m.agg(F.min("mean_value").alias("_lo"), F.max("mean_value").alias("_hi"))
    return m.crossJoin(F.broadcast(ends)).select(site, "mean_value", ((F.col("mean_value") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(0.1))).alias("ratio"))


def map_table(yields: DataFrame, areas: DataFrame, forecasts: DataFrame, site: str, value: str) -> DataFrame:
    """Mean yield per known area with its place; a site's forecast replaces its mean."""
    m = yields.groupBy(site).agg(F.avg(value).alias("_mean"))
    f = forecasts.select(site, F.col("forecast").alias("_f"))
    return m.join(areas, site).join(f, site, "left").withColumn("shown_yield", F.coalesce("_f", "_mean")).drop("_f", "_mean")


def region_filter(yields: DataFrame, areas: DataFrame, site: str, name: str | None = None) -> DataFrame:
    """Rows of configured regions, or of one of them, which must be configured; a table without the site column is empty."""
    if name is not None and areas.filter(F.col(site) == name).isEmpty():
        raise ValueError(f"region {name} is not configured")
    if site not in yields.columns:
        return yields.limit(0)
    out = yields.join(areas.select(site).distinct(), site, "left_semi")
    return out if name is None else out.filter(F.col(site) == name)


def districts(df: DataFrame, district: str, places: DataFrame) -> DataFrame:
    """Latitude and longitude by substring: the longest place name that the district contains.

    A district's substrings of the lengths that place names have meet the names by equality; no pair is tested one by one.
    """
    p = places.filter("place IS NOT NULL").select("place", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.length("place").alias("_k"))
    names = df.select(district).distinct()
    lengths = [r["_k"] for r in p.select("_k").distinct().collect()]  # as many as there are lengths of a name

    def cut(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(district) - k + 1, F.lit(1))), lambda i: F.substring(F.col(district), i, F.lit(k)))

    cuts = [cut(k) for k in lengths]
    parts = names.withColumn("place", F.explode(F.array_distinct(F.concat(*cuts)))) if cuts else names.withColumn("place", F.lit("")).limit(0)
    hit = parts.join(p, "place")
    best = hit.groupBy(district).agg(F.max_by(F.struct("_lat", "_lon"), F.struct(F.length("place"), "place")).alias("_b"))
    return df.join(best, district, "left").select(*df.columns, F.col("_b._lat").alias("lat"), F.col("_b._lon").alias("lon"))


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, r) for all pairs of columns, in one pass."""
    columns = columns or numeric_columns(df)
    pairs = [(a, b) for a, b in combinations_with_replacement(columns, 2)]
    one = df.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)))
    half = one.select(F.explode(rows).alias("x")).select("x.*")
    return half.unionByName(half.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))


def summary(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """Box-plot numbers: min, quartiles, max, and whiskers (outermost values within 1.5 times the quartile range)."""
    q = quantiles(df, key, column, [0.0, 0.25, 0.5, 0.75, 1.0])
    q = q.select(*key, *(F.col("_q")[i].alias(n) for i, n in enumerate(("min_value", "q1", "median", "q3", "max_value"))))
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(q.withColumns({"_lo": low, "_hi": high}), key) if key else df.crossJoin(F.broadcast(q.withColumns({"_lo": low, "_hi": high})))
    w = inside.groupBy(*key).agg(F.min(F.when(F.col(column) >= F.col("_lo"), F.col(column))).alias("whisker_low"), F.max(F.when(F.col(column) <= F.col("_hi"), F.col(column))).alias("whisker_high"))
    return q.join(w, key) if key else q.crossJoin(F.broadcast(w))


def _mean_abs(m: Column) -> Column:
    flat = F.flatten(m)
    return F.aggregate(flat, F.lit(0.0), lambda s, x: s + F.abs(x), lambda s: F.try_divide(s, F.size(flat).cast("double")))


def modality_importance(df: DataFrame) -> DataFrame:
    """Mean absolute attribution of each modality over all rows, rounded to 4."""
    parts = {"Satellite": _mean_abs(F.col("sat")), "Weather": _mean_abs(F.col("weather")), "Soil": _mean_abs(F.array("soil"))}
    return df.agg(*(F.round(F.avg(v), 4).alias(k) for k, v in parts.items()))


def temporal_importance(df: DataFrame, column: str = "sat") -> DataFrame:
    """Mean absolute attribution per time step over rows and channels."""
    d = df.select(F.posexplode(column).alias("step", "_r")).select("step", F.explode("_r").alias("_x"))
    return d.groupBy("step").agg(F.avg(F.abs("_x")).alias("importance"))


def feature_importance(df: DataFrame, weather_names: list[str], soil_names: list[str]) -> DataFrame:
    """Sum of absolute attributions per weather and soil feature."""
    w = df.select(F.explode("weather").alias("_r")).select(F.posexplode("_r").alias("_i", "_x"))
    s = df.select(F.posexplode("soil").alias("_i", "_x"))

    def named(d: DataFrame, names: list[str], default: str) -> DataFrame:
        known = F.get(F.array(*map(F.lit, names)).cast("array<string>"), F.col("_i"))
        return d.groupBy("_i").agg(F.sum(F.abs("_x")).alias("importance")).select(F.coalesce(known, F.concat(F.lit(default), "_i")).alias("feature"), "importance")

    return named(w, weather_names, "Weather_").unionByName(named(s, soil_names, "Soil_"))
