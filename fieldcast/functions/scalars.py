"""Column functions: vegetation indices, degree days, soil, boxes, vectors. All are built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-10
CLEAR = (4, 5, 6)


def ndvi(red: Column, nir: Column) -> Column:
    return F.try_divide(nir - red, nir + red + EPS)


def ndvi_zero_safe(red: Column, nir: Column) -> Column:
    """As ``ndvi``, but only a denominator of exactly 0 is replaced."""
    d = nir + red
    return (nir - red) / F.when(d == 0, F.lit(1e-6)).otherwise(d)


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def evi(blue: Column, red: Column, nir: Column) -> Column:
    return F.try_divide(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1 + EPS)


def lswi(nir: Column, swir: Column) -> Column:
    return F.try_divide(nir - swir, nir + swir + EPS)


def all_indices(df: DataFrame, blue="B02", red="B04", nir="B08", swir="B11", keep: list[str] | None = None) -> DataFrame:
    """ndvi and evi, and lswi where the band is there; ``keep=None`` adds them to all columns."""
    c = F.col
    out = [ndvi(c(red), c(nir)).alias("ndvi"), evi(c(blue), c(red), c(nir)).alias("evi")]
    if swir in df.columns:
        out.append(lswi(c(nir), c(swir)).alias("lswi"))
    return df.select(*(df.columns if keep is None else keep), *out)


def rescale(df: DataFrame, bands: list[str], scale: float = 10000) -> DataFrame:
    return df.withColumns({b: F.col(b) / scale for b in bands})


def cloud_mask(df: DataFrame, bands: list[str], scene: str = "SCL", clear=CLEAR) -> DataFrame:
    """NULL all bands, the scene class too, where the class isn't clear; rows stay."""
    if scene not in df.columns:
        return df
    return df.withColumns({b: F.when(F.col(scene).isin(*clear), F.col(b)) for b in [*bands, scene]})


def growing_degree_days(t_max: Column, t_min: Column, base: float = 10, cap: float = 35) -> Column:
    clip = lambda t: F.least(F.greatest(t, F.lit(float(base))), F.lit(float(cap)))
    days = F.greatest((clip(t_max) + clip(t_min)) / 2 - base, F.lit(0.0))
    return F.when(t_max.isNotNull() & t_min.isNotNull(), days)


def cyclical_month(time: Column) -> tuple[Column, Column]:
    angle = 2 * math.pi * F.month(time) / 12
    return F.sin(angle), F.cos(angle)


def soil_texture(clay: Column, sand: Column) -> Column:
    return F.when(clay > 40, "Clay").when(sand > 85, "Sand").otherwise("Loam")


def anomaly(now: Column, average: Column) -> Column:
    return F.try_divide(now - average, average + EPS)


def bbox_of_point(lat: Column, lon: Column, buffer: float = 0.01) -> Column:
    return F.array(lon - buffer, lat - buffer, lon + buffer, lat + buffer)


def in_bbox(lat: Column, lon: Column, box: Column) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def fit_length(v: Column, dim: int) -> Column:
    """Cut to ``dim``, or fill up with zeros on the right."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), dim)), 1, dim)


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def stress_flags(ndvi_col: Column, spi_col: Column) -> dict[str, Column]:
    return {"ndvi_stress": ndvi_col < 0.3, "ndvi_healthy": ndvi_col >= 0.5, "drought": spi_col < -1}
