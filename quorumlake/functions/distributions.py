"""Tail probabilities that Spark lacks, on the driver and for few rows."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction on the side where that converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / (c or tiny) or tiny
        step = c * d
        f *= step
        if abs(1 - step) < 1e-14:
            break
    return front * (f - 1)


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(F > f) for F with (df1, df2) degrees of freedom."""
    return 1.0 if f <= 0 else incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def binomial_tail(k: int, n: int, p: float = 0.5) -> float:
    """P(X >= k)."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
