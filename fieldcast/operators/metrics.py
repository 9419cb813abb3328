"""Point, interval and mixture metrics, as single aggregations; group keys are optional."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import mixture
from ..functions import laws
from ..functions.numeric import ks_one_sample_p_udf


def point_metrics(df: DataFrame, y: str, p: str, key: list[str] | None = None) -> DataFrame:
    """MAE, RMSE, R2, MAPE (in percent, with an epsilon) and mean bias, rounded to 4, 4, 4, 2 and 4."""
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    e = b - a
    sst = F.var_pop(a) * F.count(a)
    return df.groupBy(*(key or [])).agg(
        F.round(F.avg(F.abs(e)), 4).alias("mae"),
        F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"),
        F.round(1 - F.try_divide(F.sum(e * e), sst), 4).alias("r2"),
        F.round(F.avg(F.abs(F.try_divide(a - b, a + 1e-10))) * 100, 2).alias("mape"),
        F.round(F.avg(e), 4).alias("mean_bias"),
    )


def diagnostic_nll(pi: Column, sigma: Column, mu: Column, y: Column) -> Column:
    """Aggregation: minus the mean of the weighted log densities."""
    return -F.avg(mixture.weighted_log_density(pi, sigma, mu, y))


def crps_approximation(pi: Column, sigma: Column, mu: Column, y: Column) -> Column:
    """Aggregation: mean absolute error of the mixture mean plus a tenth of the mean spread (not the textbook CRPS)."""
    error, spread = mixture.crps_parts(pi, sigma, mu, y)
    return F.avg(error) + 0.1 * F.avg(spread)


def benchmark_report(df: DataFrame, y: str, p: str, std: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg((F.abs(e) <= 1.96 * F.col(std)).cast("double")).alias("calibration_95"),
        F.count(F.lit(1)).alias("num_samples"),
    )


def pit(df: DataFrame, name: str = "pit", pi="pi", sigma="sigma", mu="mu", y="y") -> DataFrame:
    return df.withColumn(name, laws.pit(*map(F.col, (pi, sigma, mu, y))))


def calibration(df: DataFrame, column: str = "pit", parts: int = 256) -> DataFrame:
    """One row: KS distance of the values from U(0, 1), p, is_calibrated, sharpness_residual.

    Equal values are counted first; prefix sums run in value ranges with offsets, not in one global window.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_p", F.least(F.greatest(F.floor(F.col("_x") * parts), F.lit(0)), F.lit(parts - 1)))
    sums = counts.groupBy("_p").agg(F.sum("_n").alias("_s"))
    base = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # at most ``parts`` rows
    upto = F.col("_b") + F.sum("_n").over(Window.partitionBy("_p").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    steps = counts.join(base, "_p").select("_x", "_n", upto.alias("_u"))
    stats = counts.agg(F.sum("_n").alias("n"), F.sum(F.col("_x") * F.col("_n")).alias("_m"), F.sum(F.col("_x") * F.col("_x") * F.col("_n")).alias("_q"))
    j = steps.crossJoin(F.broadcast(stats))
    n = F.col("n").cast("double")
    d = F.greatest(F.max(F.col("_u") / n - F.col("_x")), F.max(F.col("_x") - (F.col("_u") - F.col("_n")) / n))
    out = j.groupBy("n", "_m", "_q").agg(d.alias("ks_d"))
    spread = F.sqrt(F.greatest(F.col("_q") / n - (F.col("_m") / n) * (F.col("_m") / n), F.lit(0.0)))
    out = out.select("n", "ks_d", ks_one_sample_p_udf("ks_d", "n").alias("p_value"), F.abs(spread - 0.288).alias("sharpness_residual"))
    return out.withColumn("is_calibrated", F.col("p_value") > 0.05)
