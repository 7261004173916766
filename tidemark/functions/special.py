"""Tails of the normal, t, F and chi-square distributions in plain Python."""

from __future__ import annotations

import math


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def bisect(f, lo: float, hi: float, steps: int = 200) -> float:
    """Root of a decreasing function."""
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) > 0 else (lo, mid)
    return (lo + hi) / 2


Z975 = bisect(lambda z: normal_sf(z) - 0.025, 0, 5)


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(1000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + num * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + num / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return betainc(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Quantile above the median."""
    return bisect(lambda t: t_two_sided(t, df) / 2 - (1 - p), 0, 1e4)


def f_sf(f: float, d1: float, d2: float) -> float:
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_sf(x: float, k: int) -> float:
    """Upper tail, by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, h = k / 2, x / 2
    if h < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= h / n
            total += term
        return 1 - total * math.exp(-h + a * math.log(h) - math.lgamma(a))
    b = h + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out * math.exp(-h + a * math.log(h) - math.lgamma(a))
