"""Schemas of the known tables, and NaN to NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

YIELDS = "lat double, lon double, time string, yield double, site_id string"
SATELLITE = "site string, time timestamp, lat double, lon double, B02 double, B03 double, B04 double, B08 double, SCL int"
WEATHER = "site string, time timestamp, lat double, lon double, t_max double, t_min double, precip double"
REQUEST = "sat array<array<double>>, weather array<array<double>>, soil array<double>"
STUDY_AREAS = "name string, lat double, lon double, bbox array<double>"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values are NULL everywhere in this library."""
    floats = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns))


def numeric_columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    """Number columns in table order, without the target."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, t in df.dtypes if (t in kinds or t.startswith("decimal")) and c not in without]
