"""Normal and gamma laws and Kolmogorov's series as column expressions: no Python in the plan."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _poly(x: Column, coefficients: list[float]) -> Column:
    """By Horner's rule, constant first."""
    out = F.lit(coefficients[-1])
    for k in reversed(coefficients[:-1]):
        out = out * x + k
    return out


# Stirling's series and its derivatives, from Bernoulli numbers.
def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function of x > 0: ten steps up by the recurrence, then the asymptotic series."""
    z = x + 10
    down = sum((F.ln(x + k) for k in range(1, 10)), F.ln(x))
    f = 1 / (z * z)
    return (z - 0.5) * F.ln(z) - z + _HALF_LOG_2PI + _poly(f, [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188]) / z - down


def digamma(x: Column) -> Column:
    z = x + 10
    f = 1 / (z * z)
    return F.ln(z) - 0.5 / z - f * _poly(f, [1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132]) - sum((1 / (x + k) for k in range(1, 10)), 1 / x)


def trigamma(x: Column) -> Column:
    z = x + 10
    f = 1 / (z * z)
    return 1 / z + 0.5 * f + f / z * _poly(f, [1 / 6, -1 / 30, 1 / 42, -1 / 30]) + sum((1 / ((x + k) * (x + k)) for k in range(1, 10)), 1 / (x * x))


def gamma_shape(mean: Column, mean_log: Column, steps: int = 12) -> Column:
    """Shape of greatest likelihood (location 0) by Newton steps on ln a - digamma(a) = ln mean - mean ln; NULL where all values agree."""

    def fit(s: Column) -> Column:
        start = (3 - s + F.sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s)

        def newton(a: Column, _: Column) -> Column:
            return _let((F.ln(a) - digamma(a) - s) / (1 / a - trigamma(a)), lambda d: F.when(a > d, a - d).otherwise(a / 2))

        return F.when(s > 0, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, newton))

    return _let(F.ln(mean) - mean_log, fit)


def gamma_cdf(x: Column, a: Column) -> Column:
    """Regularised lower incomplete gamma function, by its power series from the last term back; as many terms as x and a need."""

    def series(x: Column, a: Column) -> Column:
        terms = F.least(F.ceil(F.greatest(x - a, F.lit(0.0)) + 9 * F.sqrt(F.greatest(x, a)) + 24), F.lit(20_000)).cast("int")
        total = F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), F.lit(1.0), lambda s, k: 1 + x / (a + k) * s)
        return F.when(x <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.exp(a * F.ln(x) - x - lgamma(a)) * total / a))

    return _let(F.struct(x.alias("x"), a.alias("a")), lambda v: series(v["x"], v["a"]))


# The coefficients of Wichura's rational approximations (AS 241) of the normal quantile.
_CENTRE = (
    [3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727],
    [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610],
)
_MIDDLE = (
    [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640],
    [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9],
)
_TAIL = (
    [6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 0.000786869131145613259100, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
)


def normal_quantile(p: Column) -> Column:
    """-inf at 0, inf at 1, NULL outside."""
    ratio = lambda x, c: _poly(x, c[0]) / _poly(x, c[1])

    def inside(p: Column) -> Column:
        out = _let(F.sqrt(-F.ln(F.least(p, 1 - p))), lambda r: F.when(r <= 5, _let(r - 1.6, lambda x: ratio(x, _MIDDLE))).otherwise(_let(r - 5, lambda x: ratio(x, _TAIL))))
        inner = F.when(F.abs(p - 0.5) <= 0.425, _let(p - 0.5, lambda q: q * _let(0.180625 - q * q, lambda x: ratio(x, _CENTRE)))).otherwise(F.signum(p - 0.5) * out)
        return F.when(p == 0, F.lit(float("-inf"))).when(p == 1, F.lit(float("inf"))).when((p > 0) & (p < 1), inner)

    return _let(p, inside)


def erfc(x: Column) -> Column:
    """1 - erf: a series of positive terms near 0, else a continued fraction, both from their far ends."""

    def upper(z: Column) -> Column:
        near = F.aggregate(F.sequence(F.lit(50), F.lit(1), F.lit(-1)), F.lit(1.0), lambda s, n: 1 + 2 * z * z / (2 * n + 1) * s)
        far = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), z, lambda f, n: z + 0.5 * n / f)
        return F.when(z < 2, 1 - 2 / math.sqrt(math.pi) * z * F.exp(-z * z) * near).when(z < 27.3, F.exp(-z * z) / (math.sqrt(math.pi) * far)).otherwise(0.0)

    def both(x: Column) -> Column:
        return F.when(x.isNull() | F.isnan(x), None).otherwise(_let(upper(F.abs(x)), lambda u: F.when(x < 0, 2 - u).otherwise(u)))

    return _let(x, both)


def normal_cdf(x: Column) -> Column:
    return 0.5 * erfc(-x / math.sqrt(2))


def kolmogorov_sf(x: Column) -> Column:
    """P(K > x) of Kolmogorov's law; 1 below 0.3."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, j: s + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * x * x))
    return F.when(x < 0.3, 1.0).when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * total)))


def pit(pi: Column, sigma: Column, mu: Column, y: Column) -> Column:
    """Sum of pi * Phi((y - mu) / sigma) of array columns."""
    z = F.zip_with(mu, sigma, lambda m, s: (y - m) / s)
    parts = F.zip_with(pi, z, lambda p, v: p * normal_cdf(v))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
