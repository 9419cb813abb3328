"""Covariate drift: PSI, two-sample Kolmogorov-Smirnov, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import ks_two_sample_p_udf
from .ranks import cumulative


def psi(df: DataFrame, region: str, side: str, value: str, bins: int = 10, least: int = 5) -> DataFrame:
    """Per region the PSI of side "cur" against "ref" over equal-width bins of both sides' range.

    Bins are closed on the left, the last on both sides; an empty bin counts 1e-4; one distinct value gives 0; a side of
    ``least`` values or fewer gives NULL.
    """
    d = df.filter(F.col(value).isNotNull()).select(region, side, F.col(value).cast("double").alias("_x"))
    ends = d.groupBy(region).agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"), F.count(F.when(F.col(side) == "ref", 1)).alias("n_ref"), F.count(F.when(F.col(side) == "cur", 1)).alias("n_cur"))
    edges = [F.col("_a") + (F.col("_b") - F.col("_a")) * k / bins for k in range(1, bins)]
    at = reduce(lambda a, b: a + b, ((F.col("_x") >= e).cast("int") for e in edges))
    counts = d.join(ends, region).withColumn("_bin", at).groupBy(region, "_bin").agg(F.count(F.when(F.col(side) == "ref", 1)).alias("_r"), F.count(F.when(F.col(side) == "cur", 1)).alias("_c"))
    spine = ends.withColumn("_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    j = spine.join(counts, [region, "_bin"], "left")
    share = lambda c, n: F.when(F.coalesce(c, F.lit(0)) == 0, F.lit(1e-4)).otherwise(F.try_divide(c, F.col(n)))
    r, c = share(F.col("_r"), "n_ref"), share(F.col("_c"), "n_cur")
    term = F.when(F.col("_a") < F.col("_b"), (c - r) * F.ln(c / r)).otherwise(0.0)
    out = j.groupBy(region, "n_ref", "n_cur").agg(F.sum(term).alias("_psi"))
    return out.select(region, "n_ref", "n_cur", F.when((F.col("n_ref") > least) & (F.col("n_cur") > least), F.col("_psi")).alias("psi"))


def psi_status(x: Column) -> Column:
    return F.when(x.isNull(), "SKIP").when(x >= 0.25, "BLOCK").when(x >= 0.10, "WARN").otherwise("OK")


def ks_distance(df: DataFrame, region: str, side: str, value: str, parts: int | None = None) -> DataFrame:
    """Per region the greatest gap between both sides' distribution functions.

    Values are counted first; prefix sums run in parts of even size with offsets, so one region isn't one task.
    """
    sides = {"_r": F.count(F.when(F.col(side) == "ref", 1)), "_c": F.count(F.when(F.col(side) == "cur", 1))}
    d = cumulative(df, [region], value, sides, parts)
    totals = df.filter(F.col(value).isNotNull()).groupBy(region).agg(sides["_r"].alias("n_ref"), sides["_c"].alias("n_cur"))
    gap = F.abs(F.try_divide("_upto__r", "n_ref") - F.try_divide("_upto__c", "n_cur"))
    return d.join(totals, region).groupBy(region, "n_ref", "n_cur").agg(F.max(gap).alias("ks_d"))


def ks_test(df: DataFrame, region: str, side: str, value: str, least: int = 5) -> DataFrame:
    d = ks_distance(df, region, side, value)
    enough = (F.col("n_ref") > least) & (F.col("n_cur") > least)
    return d.withColumn("ks_pvalue", ks_two_sample_p_udf(F.when(enough, F.col("ks_d")), "n_ref", "n_cur"))


def ks_status(p: Column) -> Column:
    return F.when(p.isNull(), "SKIP").when(p < 0.001, "BLOCK").when(p < 0.05, "WARN").otherwise("OK")


def overall_status(*status: Column) -> Column:
    any_ = lambda s: reduce(lambda a, b: a | b, (x == s for x in status))
    return F.when(any_("BLOCK"), "BLOCK").when(any_("WARN"), "WARN").otherwise("OK")


def exit_code(report: DataFrame) -> int:
    """1 if any region is BLOCK, else 2 if any is WARN, else 0."""
    r = report.agg(F.max((F.col("overall_status") == "BLOCK").cast("int")), F.max((F.col("overall_status") == "WARN").cast("int"))).first()
    return 1 if r[0] else 2 if r[1] else 0


def histograms(df: DataFrame, region: str, period: str, value: str, low: float, high: float, bins: int = 2000) -> DataFrame:
    """A mergeable sketch: counts of the values by region, period and fixed fine bin, with each bin's least and greatest value.

    Stored once, it answers for any two sets of periods; values beyond ``low`` and ``high`` count in the first and last bin.
    """
    x = F.col(value).cast("double")
    at = F.least(F.greatest(F.floor((x - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.filter(x.isNotNull() & ~F.isnan(x)).groupBy(region, period, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"))


def drift_of_histograms(h: DataFrame, region: str, side: Column, bins: int = 10, least: int = 5) -> DataFrame:
    """Per region n_ref, n_cur, psi, psi_off, ks_d, ks_off of stored histograms; ``side`` is "ref", "cur" or NULL for each row.

    A fine bin counts in the coarse bin that holds its least value, and as one step of the distribution functions. ``psi_off``
    is the share of all values whose fine bin lies across a coarse edge (0: the PSI is exact), ``ks_off`` bounds how far the
    true distance lies above ``ks_d``.
    """
    d = h.withColumn("_side", side).filter("_side IS NOT NULL")
    count = lambda s: F.sum(F.when(F.col("_side") == s, F.col("n")).otherwise(0))
    d = d.groupBy(region, "bin").agg(count("ref").alias("_r"), count("cur").alias("_c"), F.min("least").alias("least"), F.max("most").alias("most"))
    ends = d.groupBy(region).agg(F.min("least").alias("_a"), F.max("most").alias("_b"), F.sum("_r").alias("n_ref"), F.sum("_c").alias("n_cur"))
    d = d.join(ends, region)
    place = lambda x: F.least(F.floor(F.try_divide(x - F.col("_a"), F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1))
    d = d.withColumns({"_at": F.coalesce(place(F.col("least")), F.lit(0)), "_to": F.coalesce(place(F.col("most")), F.lit(0))})
    w = Window.partitionBy(region).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most as many rows as there are fine bins
    r, c = F.try_divide("_r", "n_ref"), F.try_divide("_c", "n_cur")
    steps = d.withColumn("_gap", F.abs(F.try_divide(F.sum("_r").over(w), "n_ref") - F.try_divide(F.sum("_c").over(w), "n_cur")))
    far = steps.groupBy(region).agg(F.max("_gap").alias("ks_d"), F.max(F.greatest(r, c)).alias("ks_off"), F.try_divide(F.sum(F.when(F.col("_at") != F.col("_to"), F.col("_r") + F.col("_c")).otherwise(0)), F.sum(F.col("_r") + F.col("_c"))).alias("psi_off"))
    coarse = d.groupBy(region, "_at").agg(F.sum("_r").alias("_r"), F.sum("_c").alias("_c"))
    spine = ends.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    j = spine.join(coarse, [region, "_at"], "left")
    share = lambda x, n: F.when(F.coalesce(x, F.lit(0)) == 0, F.lit(1e-4)).otherwise(F.try_divide(x, F.col(n)))
    p, q = share(F.col("_r"), "n_ref"), share(F.col("_c"), "n_cur")
    psi_ = j.groupBy(region, "n_ref", "n_cur").agg(F.sum(F.when(F.col("_a") < F.col("_b"), (q - p) * F.ln(q / p)).otherwise(0.0)).alias("_psi"))
    enough = (F.col("n_ref") > least) & (F.col("n_cur") > least)
    return psi_.join(far, region).select(region, "n_ref", "n_cur", F.when(enough, F.col("_psi")).alias("psi"), "psi_off", "ks_d", "ks_off")
