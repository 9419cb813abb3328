"""Gaussian mixtures in array columns pi, sigma, mu of equal length, as higher-order functions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

WARNING = "Bimodal forecast: the dominant mode is used instead of the mean."


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean(pi: Column, mu: Column) -> Column:
    return dot(pi, mu)


def std(pi: Column, sigma: Column, mu: Column) -> Column:
    second = F.zip_with(sigma, mu, lambda s, m: s * s + m * m)
    m = mean(pi, mu)
    return F.sqrt(F.greatest(dot(pi, second) - m * m, F.lit(1e-6)))


def modes(pi: Column, mu: Column, weight: float = 0.2) -> Column:
    """(weight, mean) of the components of enough weight, heaviest first, stable."""
    all_ = F.filter(F.transform(F.arrays_zip(pi.alias("w"), mu.alias("m")), lambda x, i: F.struct((-x["w"]).alias("k"), i.alias("i"), x["w"].alias("weight"), x["m"].alias("mean"))), lambda x: x["weight"] >= weight)
    return F.transform(F.array_sort(all_), lambda x: F.struct(x["weight"], x["mean"]))


def bimodality(pi: Column, sigma: Column, mu: Column, separation: float = 1.5, weight: float = 0.2) -> Column:
    found = modes(pi, mu, weight)
    a, b = F.get(found, 0), F.get(found, 1)
    apart = F.abs(a["mean"] - b["mean"]) / (dot(pi, sigma) + 1e-8)
    two = (F.size(found) >= 2) & (apart >= separation)
    depth = 1 - F.abs(a["weight"] - b["weight"]) / (a["weight"] + b["weight"] + 1e-8)
    return F.struct(
        F.coalesce(two, F.lit(False)).alias("is_bimodal"),
        found.alias("modes"),
        F.when(two, a["mean"]).otherwise(mean(pi, mu)).alias("dominant_mode"),
        F.when(two, depth).otherwise(0.0).alias("valley_depth"),
    )


def safe_estimate(report: Column) -> tuple[Column, Column]:
    """The point estimate, and a warning where it isn't the mean."""
    return report["dominant_mode"], F.when(report["is_bimodal"], WARNING)


def log_density(y: Column, mu: Column, variance: Column) -> Column:
    return -0.5 * ((y - mu) * (y - mu) / variance + F.log(variance) + math.log(2 * math.pi))


def nll(pi: Column, sigma: Column, mu: Column, y: Column, entropy_weight: float = 0.01) -> Column:
    """Negative log likelihood of a row by a shifted log-sum-exp, plus the weighted entropy term."""
    parts = F.zip_with(pi, F.zip_with(mu, sigma, lambda m, s: log_density(y, m, s * s)), lambda p, d: F.log(p + 1e-10) + d)
    top = F.array_max(parts)
    lse = top + F.log(total(F.transform(parts, lambda x: F.exp(x - top))))
    return -lse + entropy_weight * total(F.transform(pi, lambda p: p * F.log(p + 1e-10)))


def point_loss(y: Column, p: Column) -> Column:
    """To be used in an aggregation: squared plus a tenth of the absolute error."""
    return F.avg((y - p) * (y - p)) + 0.1 * F.avg(F.abs(y - p))


def interval(pi: Column, sigma: Column, mu: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    spread = z * dot(pi, sigma)
    return mean(pi, mu) - spread, mean(pi, mu) + spread


def weighted_log_density(pi: Column, sigma: Column, mu: Column, y: Column) -> Column:
    """Sum of pi * log N(y; mu, sigma^2 + 1e-6) of a row (a weighted log, not a log of a sum)."""
    return dot(pi, F.zip_with(mu, sigma, lambda m, s: log_density(y, m, s * s + 1e-6)))


def crps_parts(pi: Column, sigma: Column, mu: Column, y: Column) -> tuple[Column, Column]:
    return F.abs(y - mean(pi, mu)), dot(pi, sigma)
