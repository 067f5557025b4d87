"""Distance bins of the statistics and of the scaling table."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_END = 2**63 - 1


def stats_edges(per_decade: int = 8, decades: int = 9) -> list[int]:
    """0 and the rounded powers 10**(k / per_decade) up to 10**decades, without repeats. The last
    bin is open-ended. Halves round to the even number."""
    powers = np.round(10 ** np.arange(0, decades + 0.001, 1 / per_decade)).astype(np.int64)
    return [0, *sorted(set(powers.tolist()))]


def geometric_edges(start: int, end: int, per_decade: int = 8) -> list[int]:
    """Whole-number edges from start to end in about equal ratios: each step multiplies the exact
    value, edges that round to the one before are left out, and end closes the range."""
    count = max(2, round(math.log10(end / start) * per_decade)) if end > start else 1
    step = (end / start) ** (1 / count)
    edges, x = [start], float(start)
    for _ in range(count - 1):
        x *= step
        if (e := int(round(x))) != edges[-1]:
            edges.append(e)
    if edges[-1] != end:
        edges.append(end)
    return edges


def bin_index(edges: list[int], value: Column) -> Column:
    """Number of edges not above value: 0 below the first edge. A balanced tree of comparisons, so
    that it stays one compiled expression of logarithmic depth."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= F.lit(edges[mid]).cast("long"), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(edges))


def edge_at(edges: list[int], index: Column) -> Column:
    """edges[index] by a constant array; null outside."""
    return F.get(F.lit(np.array(edges, np.int64).tolist()).cast("array<bigint>"), index)
