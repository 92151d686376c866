"""Tail probabilities as column expressions: nothing leaves the JVM, so a p-value per group costs no Python."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

STEPS = 400  # terms of a series or continued fraction; those beyond convergence change nothing
_TINY = 1e-300


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series at z + 8, and the recurrence down to z."""
    z = _d(z)
    y = z + 8
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7)) + 1 / (1188 * F.pow(y, 9))
    down = F.log(z)
    for i in range(1, 8):
        down = down + F.log(z + i)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - down


def _fraction(first: Column, step, then) -> Column:
    """first / (1 + ...) by the modified Lentz method; step(i) gives (numerator, denominator) pairs to apply in turn."""
    away = lambda x: F.when(F.abs(x) < _TINY, _TINY).otherwise(x)

    def turn(s, i):
        for num, den in step(i):
            d = 1 / away(den + num * s["d"])
            c = away(den + num / s["c"])
            s = F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))
        return s

    return F.aggregate(F.sequence(F.lit(1), F.lit(then)), first, turn, lambda s: s["h"])


def gamma_tail(a: Column, x: Column) -> Column:
    """Upper regularised incomplete gamma function Q(a, x), a > 0, x >= 0: a series below a + 1, a continued fraction above."""
    a, x = _d(a), _d(x)
    front = F.exp(-x + a * F.log(F.greatest(x, F.lit(_TINY))) - log_gamma(a))
    term = F.struct((1 / a).alias("t"), (1 / a).alias("s"))
    low = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), term, lambda s, i: F.struct((s["t"] * x / (a + i)).alias("t"), (s["s"] + s["t"] * x / (a + i)).alias("s")), lambda s: s["s"])
    b = x + 1 - a
    begin = F.struct(F.lit(1 / _TINY).alias("c"), (1 / b).alias("d"), (1 / b).alias("h"))
    high = _fraction(begin, lambda i: [(-i * (i - a), b + 2 * i)], STEPS)
    return F.when(x <= 0, 1.0).when(x < a + 1, F.greatest(1 - front * low, F.lit(0.0))).otherwise(front * high)


def chi2_tail(x: Column, df: Column) -> Column:
    """Odds of a chi-square value of x or more."""
    return gamma_tail(_d(df) / 2, _d(x) / 2)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    d = 1 / F.when(F.abs(1 - (a + b) * x / (a + 1)) < _TINY, _TINY).otherwise(1 - (a + b) * x / (a + 1))
    begin = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
    one = F.lit(1.0)
    return _fraction(begin, lambda i: [(i * (b - i) * x / ((a - 1 + 2 * i) * (a + 2 * i)), one), (-(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 1 + 2 * i)), one)], STEPS)


def beta_part(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = _d(a), _d(b), _d(x)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(F.greatest(x, F.lit(_TINY))) + b * F.log(F.greatest(1 - x, F.lit(_TINY))))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), front * _beta_fraction(a, b, x) / a).otherwise(1 - front * _beta_fraction(b, a, 1 - x) / b)


def t_two_sided(t: Column, df: Column) -> Column:
    """Odds of a Student value as far from zero as t; null without degrees of freedom."""
    t, df = _d(t), _d(df)
    return F.when(df >= 1, beta_part(df / 2, F.lit(0.5), df / (df + t * t)))


def normal_two_sided(z: Column) -> Column:
    return gamma_tail(F.lit(0.5), _d(z) * _d(z) / 2)


EXACT = 50


def signed_rank_two_sided(ranks: Column, w_plus: Column) -> Column:
    """Two-sided odds of the signed-rank sum. ``ranks`` holds the ranks of the differences that are not zero (middle ranks on ties), ``w_plus`` the
    sum of the positive ones. Exact up to EXACT differences: signs are fair coins, and the distribution of the sum of doubled ranks is
    built up one rank at a time; beyond, the normal approximation with the tie-corrected variance, which is the sum of squares over four."""
    twice = F.transform(ranks, lambda r: F.round(r * 2).cast("int"))
    total = F.aggregate(twice, F.lit(0), lambda a, r: a + r)
    start = F.transform(F.sequence(F.lit(0), total), lambda j: F.when(j == 0, 1.0).otherwise(0.0))
    back = lambda p, j, r: F.when(j >= r, F.element_at(p, F.greatest(j - r, F.lit(0)) + 1)).otherwise(0.0)
    dist = F.aggregate(twice, start, lambda p, r: F.transform(F.sequence(F.lit(0), total), lambda j: (F.element_at(p, j + 1) + back(p, j, r)) / 2))
    at = F.round(w_plus * 2).cast("int")
    add = lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    low, high = add(F.slice(dist, 1, at + 1)), add(F.slice(dist, at + 1, total + 1))
    exact = F.least(F.lit(1.0), 2 * F.least(low, high))
    half, spread = total / 4, F.sqrt(F.aggregate(ranks, F.lit(0.0), lambda a, r: a + r * r) / 4)
    return F.when(F.size(ranks) == 0, F.lit(None).cast("double")).when(F.size(ranks) <= EXACT, exact).otherwise(normal_two_sided((w_plus - half) / spread))
