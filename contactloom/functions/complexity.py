"""Library complexity from the share of duplicates."""

from __future__ import annotations

import math


def lambert_w0(x: float) -> float:
    """Principal branch of Lambert's W for x >= -1/e, by Halley steps."""
    if x <= -1 / math.e:
        return -1.0
    if x < -0.3:  # series about the branch point
        p = math.sqrt(2 * (math.e * x + 1))
        w = -1 + p - p * p / 3 + 11 / 72 * p**3
    else:
        w = math.log1p(x) if x > -0.3 else x
    for _ in range(100):
        e = math.exp(w)
        f = w * e - x
        denominator = e * (w + 1) - (w + 2) * f / (2 * w + 2) if w != -1 else 0
        if not denominator:
            break
        step = f / denominator
        w -= step
        if abs(step) <= 1e-15 * max(1, abs(w)):
            break
    return w


def estimate_complexity(n_pairs: float, n_dups: float, n_optical: float = 0) -> float:
    """Distinct molecules of a library of which n_pairs were read, n_dups of them copies. Optical
    copies are taken off both. 0 without pairs or if all are copies, infinite without copies."""
    n = n_pairs - n_optical
    if n == 0:
        return 0.0
    unique = (n - (n_dups - n_optical)) / n
    if unique == 0:
        return 0.0
    relative = lambert_w0(-math.exp(-1 / unique) / unique) + 1 / unique
    return math.inf if relative < 1e-9 else n / relative
