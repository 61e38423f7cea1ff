"""Exact statistics as column expressions.

No lookup table is broadcast: log-factorials come from the Stirling series, so
the expressions work for any table size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)
_SHIFT = 8
_TIE = 1e-7


def rounded(c: Column, digits: int) -> Column:
    """Half-even rounding of the double itself, not of its decimal text."""
    scale = F.lit(float(10**digits))
    return F.rint(c.cast("double") * scale) / scale


def log_factorial(n: Column) -> Column:
    """ln(n!) for n >= 0, to about 1e-12.

    The series is evaluated at n + 9 and walked back by the recurrence.
    """
    x = n.cast("double") + F.lit(float(_SHIFT + 1))
    inv = F.lit(1.0) / x
    inv2 = inv * inv
    series = F.lit(0.0)
    for term in (1.0 / 1188.0, -1.0 / 1680.0, 1.0 / 1260.0, -1.0 / 360.0, 1.0 / 12.0):
        series = series * inv2 + F.lit(term)
    series = series * inv
    log_gamma = (x - F.lit(0.5)) * F.log(x) - x + F.lit(_HALF_LOG_2PI) + series
    product = F.lit(1.0)
    for k in range(1, _SHIFT + 1):
        product = product * (n.cast("double") + F.lit(float(k)))
    return log_gamma - F.log(product)


def _support(a: Column, row: Column, col_: Column, total: Column, up: bool) -> tuple[Column, Column]:
    """First and last table a walk has to visit.

    With m the mean and t the distance of ``a`` from it, terms s past ``a`` on
    its own side are below 1e-17 of the first one for s = 9*sqrt(m) + 20 (the
    distribution is log-concave and its tails are lighter than Poisson).  Equally
    rare terms on the other side are at most 2t away, for the skew of a Poisson.
    Beyond 40*sqrt(m) + 200 every term is zero in double precision.
    """
    mean = row.cast("double") * col_.cast("double") / F.greatest(total, F.lit(1)).cast("double")
    t = F.abs(a.cast("double") - mean)
    own_side = (a.cast("double") >= mean) if up else (a.cast("double") <= mean)
    near = F.when(own_side, t).otherwise(F.lit(2.0) * t) + F.lit(9.0) * F.sqrt(mean) + F.lit(20.0)
    reach = F.least(near, F.lit(40.0) * F.sqrt(mean) + F.lit(200.0))
    lo = F.greatest(F.lit(0).cast("bigint"), row + col_ - total, F.floor(mean - reach).cast("bigint"))
    hi = F.least(row, col_, F.ceil(mean + reach).cast("bigint"))
    return lo, hi


def _walk(a, row, col_, total, up: bool, limit: float | None) -> Column:
    """Sum of term(k)/term(a) for k on one side of a, a itself left out.

    With ``limit`` only terms whose log ratio is at most ``limit`` count.
    """
    lo, hi = _support(a, row, col_, total, up)
    if up:
        steps = F.when(a < hi, F.sequence(a, hi - 1)).otherwise(F.array().cast("array<bigint>"))
    else:
        steps = F.when(a > lo, F.sequence(a, lo + 1, F.lit(-1).cast("bigint"))).otherwise(
            F.array().cast("array<bigint>")
        )

    def ratio(k: Column) -> Column:
        kd, rd, cd, nd = (x.cast("double") for x in (k, row, col_, total))
        if up:
            return (rd - kd) * (cd - kd) / ((kd + 1) * (nd - rd - cd + kd + 1))
        return kd * (nd - rd - cd + kd) / ((rd - kd + 1) * (cd - kd + 1))

    def step(acc: Column, k: Column) -> Column:
        log_term = acc["t"] + F.log(ratio(k))
        term = F.exp(log_term)
        if limit is not None:
            term = F.when(log_term <= F.lit(limit), term).otherwise(F.lit(0.0))
        return F.struct(log_term.alias("t"), (acc["s"] + term).alias("s"))

    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("s"))
    return F.aggregate(steps, zero, step, lambda acc: acc["s"])


def _table(a, b, c, d):
    a, b, c, d = (x.cast("bigint") for x in (a, b, c, d))
    return a, a + b, a + c, a + b + c + d


def _observed(a, row, col_, total) -> Column:
    """Probability of the table itself, from nine log-factorials."""
    ups = (row, total - row, col_, total - col_)
    downs = (total, a, row - a, col_ - a, total - row - col_ + a)
    signed = [(n, 1.0) for n in ups] + [(n, -1.0) for n in downs]
    parts = F.array(*[F.struct(n.alias("n"), F.lit(sign).alias("sign")) for n, sign in signed])
    return F.exp(F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p["sign"] * log_factorial(p["n"])))


def _guard(p: Column, a, b, c, d) -> Column:
    """A table with a negative cell has no test: p is 1."""
    bad = (F.least(a, b, c, d) < 0)
    return F.when(bad, F.lit(1.0)).otherwise(F.least(F.lit(1.0), p))


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided Fisher exact p of [[a, b], [c, d]]."""
    x, row, col_, total = _table(a, b, c, d)
    limit = math.log1p(_TIE)
    tail = F.lit(1.0) + _walk(x, row, col_, total, True, limit) + _walk(x, row, col_, total, False, limit)
    return _guard(_observed(x, row, col_, total) * tail, a, b, c, d)


def fisher_greater(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One-sided Fisher exact p: at least ``a`` in the first cell."""
    x, row, col_, total = _table(a, b, c, d)
    # From below the mean the ratios overflow, so sum the short side instead.
    above = _observed(x, row, col_, total) * (F.lit(1.0) + _walk(x, row, col_, total, True, None))
    below = F.lit(1.0) - _observed(x, row, col_, total) * _walk(x, row, col_, total, False, None)
    past_mean = x.cast("double") * total >= row.cast("double") * col_.cast("double")
    return _guard(F.when(past_mean, above).otherwise(below), a, b, c, d)


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Sample odds ratio; inf when only the divisor is 0, NaN when both are."""
    num = a.cast("double") * d.cast("double")
    den = b.cast("double") * c.cast("double")
    return (
        F.when(F.least(a, b, c, d) < 0, F.lit(1.0))
        .when(den != 0, num / F.nullif(den, F.lit(0.0)))
        .when(num != 0, F.lit(float("inf")))
        .otherwise(F.lit(float("nan")))
    )


def neg_log10(p: Column) -> Column:
    return F.when(p > 0, -F.log10(p)).otherwise(F.lit(float("inf")))


def rate(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """numerator/denominator as double; 0 when the denominator is 0 or null."""
    ratio = F.try_divide(numerator.cast("double") * F.lit(scale), denominator.cast("double"))
    return F.coalesce(ratio, F.lit(0.0))


def chi_square(observed: Column, expected: Column) -> Column:
    return F.try_divide((observed - expected) * (observed - expected), expected)


def chi_square_p_1df(statistic: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom: erfc(sqrt(x/2)).

    The standard continued fraction is used above 2 and the power series below.
    """
    x = F.sqrt(statistic / F.lit(2.0))
    x2 = x * x
    series = F.lit(0.0)
    for n in range(40, -1, -1):
        # erf(x) = 2/sqrt(pi) * sum (-1)^n x^(2n+1) / (n! (2n+1)), Horner form
        series = series * x2 * F.lit(-1.0) + F.lit(1.0 / (math.factorial(n) * (2 * n + 1)))
    small = F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * x * series
    fraction = x
    for n in range(60, 0, -1):
        fraction = x + F.lit(n / 2.0) / fraction
    large = F.exp(-x2) / (F.lit(math.sqrt(math.pi)) * fraction)
    return F.when(statistic <= 0, F.lit(1.0)).when(x < 2.0, small).otherwise(large)
