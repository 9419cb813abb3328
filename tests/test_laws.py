"""The laws as column expressions against the array versions and the standard library."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast.functions import laws, numeric


def values(spark, rows, schema, column):
    return [r["y"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").withColumn("y", column).orderBy("i").collect()]


def test_gamma_functions(spark):
    xs = [1e-3, 0.2, 1.0, 2.5, 9.99, 50.0, 1e4]
    rows = [(x,) for x in xs]
    assert values(spark, rows, "x double", laws.lgamma(F.col("x"))) == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-12)
    assert values(spark, rows, "x double", laws.digamma(F.col("x"))) == pytest.approx([numeric.digamma(x) for x in xs], rel=1e-11, abs=1e-11)
    assert values(spark, rows, "x double", laws.trigamma(F.col("x"))) == pytest.approx([numeric.trigamma(x) for x in xs], rel=1e-10)


def test_gamma_fit_and_cdf(spark):
    rng = np.random.default_rng(2)
    samples = [rng.gamma(a, 2.0, 200) for a in (0.3, 1.0, 7.0, 400.0)]
    rows = [(float(s.mean()), float(np.log(s).mean())) for s in samples]
    assert values(spark, rows, "m double, g double", laws.gamma_shape(F.col("m"), F.col("g"))) == pytest.approx([numeric.gamma_fit(*r)[0] for r in rows], rel=1e-10)
    assert values(spark, [(3.0, math.log(3.0)), (None, 1.0)], "m double, g double", laws.gamma_shape(F.col("m"), F.col("g"))) == [None, None]
    pairs = [(float(a * t), a) for a in (0.3, 1.0, 7.5, 400.0) for t in (0.001, 0.5, 0.99, 1.0, 1.2, 3.0)] + [(0.0, 2.0)]
    want = numeric.gamma_cdf(np.array([x for x, _ in pairs]), np.array([a for _, a in pairs]))
    assert values(spark, pairs, "x double, a double", laws.gamma_cdf(F.col("x"), F.col("a"))) == pytest.approx(want.tolist(), abs=1e-12)


def test_normal_law(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.01, 0.075, 0.3, 0.5, 0.6, 0.93, 0.9999, 1 - 1e-12]
    assert values(spark, [(p,) for p in ps], "p double", laws.normal_quantile(F.col("p"))) == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-12, abs=1e-12)
    assert values(spark, [(0.0,), (1.0,), (-0.1,), (None,)], "p double", laws.normal_quantile(F.col("p"))) == [-math.inf, math.inf, None, None]
    zs = [-40.0, -9.0, -3.0, -2.0, -0.5, 0.0, 1e-9, 1.0, 2.9, 6.0, 40.0]
    assert values(spark, [(z,) for z in zs], "z double", laws.normal_cdf(F.col("z"))) == pytest.approx([0.5 * math.erfc(-z / math.sqrt(2)) for z in zs], rel=1e-11, abs=1e-300)


def test_kolmogorov(spark):
    xs = [0.0, 0.2, 0.5, 1.0, 2.0, 5.0]
    assert values(spark, [(x,) for x in xs], "x double", laws.kolmogorov_sf(F.col("x"))) == pytest.approx([numeric.kolmogorov_sf(x) for x in xs], abs=1e-12)
