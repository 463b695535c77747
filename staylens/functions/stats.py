"""Small numeric helpers that run inside tasks on one row per estimate."""

from __future__ import annotations

import math

import numpy as np


def student_quantile(p: float, df: int) -> float:
    """Quantile of Student's t for p > 0.5, by bisection on the distribution function. With t = sqrt(df) tan(a) the
    density becomes cos(a)^(df - 1) up to a constant, which Gauss-Legendre nodes integrate accurately."""
    nodes, weights = np.polynomial.legendre.leggauss(80)
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)

    def upper_half(t: float) -> float:
        a = math.atan(t / math.sqrt(df))
        x = (nodes + 1) * a / 2
        return scale * float(np.sum(weights * np.cos(x) ** (df - 1))) * a / 2

    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        if upper_half(mid) < p - 0.5:
            low = mid
        else:
            high = mid
    return (low + high) / 2
