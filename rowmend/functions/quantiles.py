"""Quantiles of the normal, chi-square and Student distributions, for a handful of scalars on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

MAX_TERMS = 10_000_000  # of a continued fraction; it is an error to need more


def norm_ppf(p: float, mean: float = 0.0, std: float = 1.0) -> float:
    return mean + std * NormalDist().inv_cdf(p)


def _bisect(cdf, p: float, hi: float) -> float:
    lo = 0.0
    while cdf(hi) < p:
        lo, hi = hi, hi * 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return 0.5 * (lo + hi)


def gamma_cdf(shape: float, x: float) -> float:
    """Regularised lower incomplete gamma function (series, or continued fraction in the tail)."""
    if x <= 0:
        return 0.0
    log_front = shape * math.log(x) - x - math.lgamma(shape)
    if x < shape + 1:
        term = total = 1.0 / shape
        k = shape
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(log_front)
    tiny = 1e-300
    b = x + 1 - shape
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, MAX_TERMS):
        a = -i * (i - shape)
        b += 2
        d = 1 / (a * d + b or tiny)
        c = b + a / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    else:
        raise ArithmeticError(f"the incomplete gamma function of {shape}, {x} does not settle")
    return 1.0 - h * math.exp(log_front)


def chi2_ppf(p: float, dof: float) -> float:
    if dof == 1:
        return norm_ppf((1 + p) / 2) ** 2
    return _bisect(lambda x: gamma_cdf(dof / 2, x / 2), p, max(dof, 1.0))


def _beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_cdf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, MAX_TERMS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        delta = 1.0
        for step in (even, odd):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            delta = c * d
            h *= delta
        if abs(delta - 1) < 1e-15:
            break
    else:
        raise ArithmeticError(f"the incomplete beta function of {a}, {b}, {x} does not settle")
    return front * h


LARGE_DOF = 10_000


def t_ppf(p: float, dof: float) -> float:
    """Student quantile.  Far out the beta function loses digits, so many degrees of freedom use the expansion around the
    normal quantile, whose error there is below 1e-15 for usual p."""
    if p < 0.5:
        return -t_ppf(1 - p, dof)
    if dof >= LARGE_DOF:
        z = norm_ppf(p)
        first = (z**3 + z) / 4
        second = (5 * z**5 + 16 * z**3 + 3 * z) / 96
        third = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
        return z + (first + (second + third / dof) / dof) / dof

    def cdf(t):
        return 1 - 0.5 * _beta_cdf(dof / 2, 0.5, dof / (dof + t * t))

    return _bisect(cdf, p, 2.0)
