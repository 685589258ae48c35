"""Arithmetic grids (F2) and safe ratios."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def grid_size(lo: float, hi: float, step: float) -> int:
    """Number of points of a half-open arithmetic range [lo, hi)."""
    return int(math.ceil((hi - lo) / step))


def grid_delta(lo: float, step: float) -> float:
    """The increment actually used between points: ``(lo + step) - lo``.

    Using it (rather than ``step``) makes every point bit-identical to the
    usual array-library range, which matters when scores sit on the grid."""
    return (lo + step) - lo


def grid_values(lo: float, hi: float, step: float) -> list[float]:
    d = grid_delta(lo, step)
    return [lo + i * d for i in range(grid_size(lo, hi, step))]


def grid_point(i: Column, lo: float, step: float) -> Column:
    return F.lit(lo) + i * F.lit(grid_delta(lo, step))


def grid_sql(lo: float, hi: float, step: float, idx: str = "i") -> tuple[str, str]:
    """(DuckDB range expression, point expression) for the oracle SQL."""
    return (f"range(0, {grid_size(lo, hi, step)})",
            f"({lo!r}::DOUBLE + {idx} * {grid_delta(lo, step)!r}::DOUBLE)")


def safe_div(num: Column, den: Column) -> Column:
    """Ratio that is 0 when the denominator is 0 (the usual metric default)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def grid_index_at_most(score: Column, lo: float, step: float, n: int) -> Column:
    """Largest grid index ``i`` with ``point(i) <= score`` (``-1`` if none),
    exact with respect to the floating grid points."""
    d = grid_delta(lo, step)
    guess = F.floor((score - F.lit(lo)) / F.lit(d)).cast("int")
    g = F.least(F.greatest(guess, F.lit(-1)), F.lit(n - 1))
    pt = lambda k: F.lit(lo) + k * F.lit(d)
    g = F.when((g >= 0) & (score < pt(g)), g - 1).otherwise(g)
    g = F.when((g + 1 <= n - 1) & (score >= pt(g + 1)), g + 1).otherwise(g)
    return g
