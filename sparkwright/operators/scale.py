"""Scaling and numeric transforms.

Fit = one fused aggregate over the rows selected by ``fit_where`` (all rows,
or only the train split); apply = a column expression over every row, with
the one-row statistics frame broadcast-joined (no driver round trip).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.columns import numeric_columns, q, quantile_set
from sparkwright.functions.columns import attach_one_row


def _cols(df, columns):
    return list(columns) if columns is not None else numeric_columns(df)


def _fit_rows(df: DataFrame, fit_where: Column | None) -> DataFrame:
    return df.where(fit_where) if fit_where is not None else df


def _apply(df: DataFrame, stats: DataFrame, exprs: dict) -> DataFrame:
    j = attach_one_row(df, stats)
    return j.select(*[exprs[c].alias(c) if c in exprs else q(c) for c in df.columns])


def scaler_exprs(rows: DataFrame, columns: Sequence[str], method: str, exact: bool | None = None) -> list[tuple[Column, Column]]:
    """Aggregates (centre, scale) of each column, for one aggregation over ``rows``."""
    found = quantile_set(rows, [(q(c), [0.25, 0.5, 0.75]) for c in columns], exact) if method == "robust" else []
    out = []
    for i, c in enumerate(columns):
        x = q(c).cast("double")
        if method == "standard":
            centre, spread = F.avg(x), F.stddev_pop(x)
        elif method == "minmax":
            centre, spread = F.min(x), F.max(x) - F.min(x)
        elif method == "robust":
            centre, spread = found[i][1], found[i][2] - found[i][0]
        elif method == "maxabs":
            centre, spread = F.lit(0.0), F.max(F.abs(x))
        else:
            raise ValueError(f"unknown scaling {method!r}")
        out.append((centre, F.when(spread == 0, 1.0).otherwise(spread)))
    return out


def scaler_stats(df: DataFrame, columns: Sequence[str], method: str,
                 fit_where: Column | None = None, exact: bool | None = None) -> DataFrame:
    """One-row frame of fitted statistics ``__a{i}``/``__b{i}`` (centre, scale)."""
    rows = _fit_rows(df, fit_where)
    exprs = scaler_exprs(rows, columns, method, exact)
    return rows.agg(*[x for i, (a, b) in enumerate(exprs) for x in (a.alias(f"__a{i}"), b.alias(f"__b{i}"))])


def scale(df: DataFrame, method: str = "standard", columns: Sequence[str] | None = None,
          fit_where: Column | None = None, exact: bool | None = None) -> DataFrame:
    """standard: (x-mean)/population std; minmax: (x-min)/(max-min);
    robust: (x-median)/IQR; maxabs: x/max|x|.  A zero spread divides by 1."""
    cols = _cols(df, columns)
    if not cols:
        return df
    stats = scaler_stats(df, cols, method, fit_where, exact)
    exprs = {c: (q(c).cast("double") - F.col(f"__a{i}")) / F.col(f"__b{i}") for i, c in enumerate(cols)}
    return _apply(df, stats, exprs)


# --------------------------------------------------------------------- G6 / G7
def log1p(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """log(1+x); null where x <= -1 (undefined)."""
    cs = set(columns)
    return df.select(*[F.when(q(c) > -1, F.log1p(q(c).cast("double"))).alias(c) if c in cs else q(c)
                       for c in df.columns])


def sqrt(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Square root; null for negative values."""
    cs = set(columns)
    return df.select(*[F.when(q(c) >= 0, F.sqrt(q(c).cast("double"))).alias(c) if c in cs else q(c)
                       for c in df.columns])


# --------------------------------------------------------------------- G8
def yeo_johnson_expr(x: Column, lam: float) -> Column:
    x = x.cast("double")
    pos = (F.log1p(x) if abs(lam) < 1e-12
           else (F.pow(x + 1.0, F.lit(lam)) - 1.0) / F.lit(lam))
    neg = (-F.log1p(-x) if abs(lam - 2) < 1e-12
           else -(F.pow(-x + 1.0, F.lit(2.0 - lam)) - 1.0) / F.lit(2.0 - lam))
    return F.when(x >= 0, pos).otherwise(neg)


FARTHEST = 1000.0     # lambdas beyond it are not looked for


def yeo_johnson_lambdas(df: DataFrame, columns: Sequence[str], lo: float = -5.0, hi: float = 5.0,
                        grid: int = 41, rounds: int = 4) -> dict[str, float]:
    """Maximum-likelihood lambda of each column: a grid of candidates for all columns in one aggregation.

    While the best candidate of a column lies at an end of its bracket, the bracket moves on beyond it and
    grows; then it shrinks around the best candidate ``rounds - 1`` times.  1 without values or spread.
    """
    best = {c: 1.0 for c in columns}
    if not columns:
        return best
    xs = {c: q(c).cast("double") for c in columns}
    base = df.agg(*[a for i, (c, x) in enumerate(xs.items()) for a in (
        F.count(x).alias(f"n{i}"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"s{i}"))]).first()
    state = {c: (lo, hi, rounds) for i, c in enumerate(columns) if base[f"n{i}"]}
    while state:
        asked = {c: [a + (b - a) * k / (grid - 1) for k in range(grid)] for c, (a, b, _) in state.items()}
        row = df.agg(*[a for c, lams in asked.items() for k, lam in enumerate(lams) for y in [yeo_johnson_expr(xs[c], lam)]
                       for a in (F.var_pop(y).alias(f"v{columns.index(c)}_{k}"), F.avg(y).alias(f"m{columns.index(c)}_{k}"))]).first()
        for c, lams in asked.items():
            i, (a, b, left) = columns.index(c), state.pop(c)
            n, s = base[f"n{i}"], base[f"s{i}"]
            # log-likelihood: -n/2 log(var(y)) + (lam - 1) * sum(sign(x) log1p|x|); a variance that is rounding does not count
            scores = [(-n / 2.0 * math.log(v) + (lam - 1.0) * s, lam, k) for k, lam in enumerate(lams)
                      for v, m in [(row[f"v{i}_{k}"], row[f"m{i}_{k}"])]
                      if v is not None and math.isfinite(v) and math.isfinite(m) and v > 1e-24 * m * m]
            if not scores:
                continue
            _, best[c], k = max(scores)
            step, wide = (b - a) / (grid - 1), b - a
            if k in (0, grid - 1) and left == rounds and abs(best[c]) < FARTHEST:
                state[c] = (best[c] - step, best[c] + 2 * wide, left) if k else (best[c] - 2 * wide, best[c] + step, left)
            elif left > 1:
                state[c] = (best[c] - step, best[c] + step, left - 1)
    return best


def yeo_johnson_lambda(df: DataFrame, column: str, lo: float = -5.0, hi: float = 5.0,
                       grid: int = 41, rounds: int = 4) -> float:
    """``yeo_johnson_lambdas`` of one column."""
    return yeo_johnson_lambdas(df, [column], lo, hi, grid, rounds)[column]


def yeo_johnson(df: DataFrame, columns: Sequence[str], lambdas: dict | None = None,
                standardize: bool = True, fit_where: Column | None = None) -> tuple[DataFrame, dict]:
    """Yeo-Johnson power transform (lambda fitted unless given), then
    standardised with the population std of the transformed column."""
    lam = dict(lambdas or {})
    fit_rows = _fit_rows(df, fit_where)
    lam |= yeo_johnson_lambdas(fit_rows, [c for c in columns if c not in lam])
    out = df.select(*[yeo_johnson_expr(q(c), lam[c]).alias(c) if c in lam else q(c) for c in df.columns])
    if standardize:
        out = scale(out, "standard", list(columns),
                    fit_where=fit_where)
    return out, lam


# --------------------------------------------------------------------- G9 / B4 / P9
def iqr_bounds_frame(df: DataFrame, columns: Sequence[str], k: float = 1.5,
                     exact: bool | None = None) -> DataFrame:
    aggs = []
    for i, qs in enumerate(quantile_set(df, [(q(c), [0.25, 0.75]) for c in columns], exact)):
        iqr = qs[1] - qs[0]
        aggs += [(qs[0] - F.lit(k) * iqr).alias(f"__lo{i}"), (qs[1] + F.lit(k) * iqr).alias(f"__hi{i}")]
    return df.agg(*aggs)


def clip_iqr(df: DataFrame, columns: Sequence[str], k: float = 1.5, exact: bool | None = None) -> DataFrame:
    """Clip to the IQR fences; nulls stay null."""
    b = iqr_bounds_frame(df, columns, k, exact)
    exprs = {}
    for i, c in enumerate(columns):
        x = q(c).cast("double")
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        exprs[c] = F.when(x < lo, lo).when(x > hi, hi).otherwise(x)
    return _apply(df, b, exprs)


def remove_outliers_iqr(df: DataFrame, columns: Sequence[str], k: float = 1.5,
                        exact: bool | None = None) -> DataFrame:
    """Keep rows inside every fence (rows with a null in these columns go too)."""
    b = iqr_bounds_frame(df, columns, k, exact)
    cond = F.lit(True)
    for i, c in enumerate(columns):
        cond = cond & q(c).between(F.col(f"__lo{i}"), F.col(f"__hi{i}"))
    j = attach_one_row(df, b)
    return j.where(F.coalesce(cond, F.lit(False))).select(*[q(c) for c in df.columns])


def winsorize(df: DataFrame, columns: Sequence[str], lower: float = 0.05, upper: float = 0.95,
              exact: bool | None = None) -> DataFrame:
    """Clip to the given percentiles."""
    aggs = []
    for i, qs in enumerate(quantile_set(df, [(q(c), [lower, upper]) for c in columns], exact)):
        aggs += [qs[0].alias(f"__lo{i}"), qs[1].alias(f"__hi{i}")]
    b = df.agg(*aggs)
    exprs = {}
    for i, c in enumerate(columns):
        x = q(c).cast("double")
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        exprs[c] = F.when(x < lo, lo).when(x > hi, hi).otherwise(x)
    return _apply(df, b, exprs)
