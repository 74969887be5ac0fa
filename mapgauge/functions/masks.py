"""Validity masks and depth bins as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
FIXED = (1.0, 5.0)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """Neither null, NaN nor infinite; NaN compares as larger than any number, so it needs its own test."""
    c = col(c)
    return F.coalesce(~F.isnan(c) & (c < INF) & (c > -INF), F.lit(False))


def only_finite(c: Column | str) -> Column:
    return F.when(finite(c), col(c))


def valid(gt="gt", pred="pred", sky: Column | str | None = None, least: float = 0.0) -> Column:
    """Both depths finite and above `least`, and not sky. A null sky flag is no sky."""
    ok = (col(gt) > least) & (col(pred) > least) & finite(gt) & finite(pred)
    return F.coalesce(ok, F.lit(False)) & (~F.coalesce(col(sky), F.lit(False)) if sky is not None else F.lit(True))


def fit_mask(gt="gt", source="pred", sky: Column | str | None = None) -> Column:
    """Pixels for an affine fit: the prediction may be zero or negative."""
    ok = F.coalesce((col(gt) > 0) & finite(gt) & finite(source), F.lit(False))
    return ok & (~F.coalesce(col(sky), F.lit(False)) if sky is not None else F.lit(True))


def fixed_bin(depth="depth", near: float = FIXED[0], far: float = FIXED[1]) -> Column:
    """near, mid or far; null for invalid depth."""
    d = col(depth)
    return F.when(finite(d) & (d > 0), F.when(d <= near, "near").when(d <= far, "mid").otherwise("far"))


def benchmark_edges(low: float, high: float) -> tuple[float, float]:
    """Inner edges of three bins of equal width in the square root of depth."""
    if low < 0 or high <= low:
        raise ValueError("a benchmark range needs 0 <= low < high")
    a, b = math.sqrt(low), math.sqrt(high)
    q = (b - a) / 3
    return (a + q) ** 2, (a + 2 * q) ** 2


def benchmark_bin(depth, low: float, high: float) -> Column:
    """near, mid or far within [low, high]; null outside."""
    d, (first, second) = col(depth), benchmark_edges(low, high)
    inside = finite(d) & (d >= low) & (d <= high)
    return F.when(inside, F.when(d < first, "near").when(d < second, "mid").otherwise("far"))


def benchmark_key(low: float, high: float) -> str:
    """A name such as benchmark_0_5m_100m."""
    name = lambda x: f"{x:g}".replace(".", "_")
    return f"benchmark_{name(low)}m_{name(high)}m"


def ray_valid(*xyz: str) -> Column:
    """All norms finite and above 1e-8. Takes gx, gy, gz, px, py, pz."""
    out = F.lit(True)
    for k in range(0, len(xyz), 3):
        n = F.sqrt(sum((F.col(c) * F.col(c) for c in xyz[k + 1 : k + 3]), F.col(xyz[k]) * F.col(xyz[k])))
        out = out & finite(n) & (n > 1e-8)
    return F.coalesce(out, F.lit(False))
