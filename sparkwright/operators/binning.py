"""Binning (F8-F10): equal width, equal frequency, custom edges.

Edges come from one aggregate (min/max or exact quantiles), joined back as
a broadcast one-row frame; the bin index is a plain column expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.columns import q, quantiles
from sparkwright.functions.columns import attach_one_row

EDGE_WIDEN = 0.001   # the lowest edge is moved down by 0.1 % of the range (fixed value)


def _replace(df: DataFrame, column: str, expr, out: str | None) -> DataFrame:
    name = out or column
    if name == column:
        return df.select(*[expr.alias(c) if c == column else q(c) for c in df.columns])
    return df.select(*[q(c) for c in df.columns], expr.alias(name))


def equal_width_index(x, lo, hi, bins: int):
    """Right-closed equal-width bin index: the number of inner edges below x.

    The edges are ``lo + i * (hi - lo) / bins``; a constant column is widened
    by 0.1 % of its absolute value (or 0.001 at zero) on both sides.
    """
    x = x.cast("double")
    adj = F.when(lo == hi, F.when(lo == 0, F.lit(EDGE_WIDEN)).otherwise(F.abs(lo) * EDGE_WIDEN)).otherwise(0.0)
    lo2, hi2 = lo - adj, hi + adj
    step = (hi2 - lo2) / F.lit(bins)
    idx = sum((F.when(lo2 + F.lit(i) * step < x, 1).otherwise(0) for i in range(1, bins)), F.lit(0))
    return F.when(x.isNotNull(), idx)


def bin_equal_width(df: DataFrame, column: str, bins: int = 5, out: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max], index 0..bins-1, right-closed."""
    x = q(column).cast("double")
    rng = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    j = attach_one_row(df, rng)
    e = equal_width_index(q(column), F.col("__lo"), F.col("__hi"), bins)
    return _replace(j, column, e, out).drop("__lo", "__hi")


def quantile_edges(df: DataFrame, column: str, q_bins: int, exact: bool | None = None) -> DataFrame:
    """One-row frame ``__edges``: distinct linear-interpolated quantile edges."""
    probs = [i / q_bins for i in range(q_bins + 1)]
    return df.agg(F.array_distinct(quantiles(df, q(column), probs, exact)).alias("__edges"))


def bin_equal_freq(df: DataFrame, column: str, q_bins: int = 5, out: str | None = None,
                   exact: bool | None = None) -> DataFrame:
    """Equal-frequency bins: duplicate edges dropped, right-closed, lowest
    value included (index = edges below x, minus one, floored at 0)."""
    edges = quantile_edges(df, column, q_bins, exact)
    j = attach_one_row(df, edges)
    x = q(column).cast("double")
    idx = F.greatest(F.size(F.filter(F.col("__edges"), lambda e: e < x)) - 1, F.lit(0))
    return _replace(j, column, F.when(x.isNotNull(), idx), out).drop("__edges")


def bin_custom(df: DataFrame, column: str, edges: Sequence[float], out: str | None = None) -> DataFrame:
    """Custom increasing edges, right-closed; the lowest edge itself and values
    outside ``(e0, ek]`` are null."""
    e = [float(v) for v in edges]
    if any(b <= a for a, b in zip(e, e[1:])):
        raise ValueError("bin edges must increase")
    x = q(column).cast("double")
    expr = F.lit(None).cast("int")
    for i in range(len(e) - 1, 0, -1):
        expr = F.when((x > F.lit(e[i - 1])) & (x <= F.lit(e[i])), F.lit(i - 1)).otherwise(expr)
    return _replace(df, column, expr, out)


def parse_edges(text: str) -> list[float]:
    """Edges typed as a comma-separated list."""
    return [float(t) for t in text.split(",") if t.strip()]
