"""Distribution functions and quantiles of the normal, t, F, chi-square and beta laws.

Series and continued fractions as in the usual handbooks; quantiles by safeguarded
bisection and Newton steps on the distribution function.
"""

from __future__ import annotations

import math
from statistics import NormalDist

_N = NormalDist()
_EPS = 1e-16


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    if p <= 0:
        return -math.inf
    return math.inf if p >= 1 else _N.inv_cdf(p)


def gamma_cdf(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function P(a, x)."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * _EPS:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * scale)
    # Lentz's method on the continued fraction of Q(a, x)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for n in range(1, 10_000):
        an = -n * (n - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < _EPS:
            break
    return max(0.0, 1 - scale * h)


def chi2_cdf(x: float, df: float) -> float:
    return gamma_cdf(df / 2, x / 2)


def chi2_sf(x: float, df: float) -> float:
    return 1 - chi2_cdf(x, df)


def _beta_fraction(x: float, a: float, b: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < _EPS * 4:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(x, a, b) / a
    return 1 - front * _beta_fraction(1 - x, b, a) / b


def t_cdf(x: float, df: float) -> float:
    if math.isinf(df):
        return norm_cdf(x)
    tail = 0.5 * beta_cdf(df / (df + x * x), df / 2, 0.5)
    return 1 - tail if x > 0 else tail


def t_sf2(x: float, df: float) -> float:
    """Two-sided tail."""
    x = float(x)
    return beta_cdf(df / (df + x * x), df / 2, 0.5) if not math.isinf(df) else math.erfc(abs(x) / math.sqrt(2))


def f_cdf(x: float, d1: float, d2: float) -> float:
    return 0.0 if x <= 0 else beta_cdf(d1 * x / (d1 * x + d2), d1 / 2, d2 / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_cdf(d2 / (d1 * x + d2), d2 / 2, d1 / 2)


def _solve(cdf, p: float, low: float, high: float) -> float:
    """The point where an increasing ``cdf`` reaches ``p``, by bisection with secant steps."""
    f_low, f_high = cdf(low) - p, cdf(high) - p
    for n in range(400):
        mid = (low + high) / 2
        if n % 3 and f_high != f_low:
            guess = low - f_low * (high - low) / (f_high - f_low)
            if low < guess < high:
                mid = guess
        f = cdf(mid) - p
        if f == 0 or high - low <= 1e-15 * max(1.0, abs(mid)):
            return mid
        if f < 0:
            low, f_low = mid, f
        else:
            high, f_high = mid, f
    return (low + high) / 2


def _grow(cdf, p: float) -> float:
    high = 1.0
    while cdf(high) < p and high < 1e300:
        high *= 2
    return high


def t_ppf(p: float, df: float) -> float:
    if not df > 0:
        return math.nan
    if math.isinf(df):
        return norm_ppf(p)
    if p in (0.0, 1.0):
        return math.copysign(math.inf, p - 0.5)
    if p < 0.5:
        return -t_ppf(1 - p, df)
    if p == 0.5:
        return 0.0
    # the tail keeps its precision where the distribution function is near 1
    tail = lambda x: 1 - 0.5 * beta_cdf(df / (df + x * x), df / 2, 0.5)
    return _solve(tail, p, 0.0, _grow(tail, p))


def chi2_ppf(p: float, df: float) -> float:
    cdf = lambda x: chi2_cdf(x, df)
    return _solve(cdf, p, 0.0, _grow(cdf, p))


def f_ppf(p: float, d1: float, d2: float) -> float:
    cdf = lambda x: f_cdf(x, d1, d2)
    return _solve(cdf, p, 0.0, _grow(cdf, p))


def beta_ppf(p: float, a: float, b: float) -> float:
    if p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    return _solve(lambda x: beta_cdf(x, a, b), p, 0.0, 1.0)
