"""Missing-value operators.

Fill statistics come from one fused aggregate (mean / exact median) or a
``groupBy`` per column (mode); the fill itself is a ``coalesce`` projection.
The only values brought to the driver are one statistic per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.columns import numeric_columns, q, quantile_set
from sparkwright.operators import ordered
from sparkwright.operators.profile import mode_table

UNKNOWN = "Unknown"   # fill for a text column without any value (fixed value)
AUTO_DROP_BELOW = 0.05
AUTO_KNN_BELOW = 0.30


def _fill(df: DataFrame, values: dict) -> DataFrame:
    out = []
    for c in df.columns:
        if c in values and values[c] is not None:
            v = values[c]
            out.append(F.coalesce(q(c), F.lit(v)).alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


def columns_with_nulls(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The given columns that hold at least one missing value (one pass)."""
    if not columns:
        return []
    r = df.agg(*[F.max(q(c).isNull().cast("int")).alias(f"__n{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if r[f"__n{i}"]]


def column_means(df: DataFrame, columns: Sequence[str]) -> dict:
    if not columns:
        return {}
    r = df.agg(*[F.avg(q(c).cast("double")).alias(f"__a{i}") for i, c in enumerate(columns)]).first()
    return {c: r[f"__a{i}"] for i, c in enumerate(columns)}


def column_medians(df: DataFrame, columns: Sequence[str], exact: bool | None = None) -> dict:
    if not columns:
        return {}
    found = quantile_set(df, [(q(c), [0.5]) for c in columns], exact)
    r = df.agg(*[m[0].alias(f"__m{i}") for i, m in enumerate(found)]).first()
    return {c: r[f"__m{i}"] for i, c in enumerate(columns)}


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict:
    """Mode per column (smallest value on ties; null without values), all columns in one job."""
    if not columns:
        return {}
    found = {r["i"]: r["v"] for r in mode_table(df, columns).collect()}      # one row per column
    kinds = [df.schema[c].dataType for c in columns]
    row = df.sparkSession.range(1).select(*[F.lit(found.get(i)).cast(k).alias(f"c{i}") for i, k in enumerate(kinds)]).first()
    return {c: row[f"c{i}"] for i, c in enumerate(columns)}


def _as_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cs = set(cols)
    return df.select(*[q(c).cast("double").alias(c) if c in cs else q(c) for c in df.columns])


def impute_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill with the column mean (columns with gaps become double)."""
    cols = columns_with_nulls(df, list(columns) if columns is not None else numeric_columns(df))
    return _fill(_as_double(df, cols), column_means(df, cols))


def impute_median(df: DataFrame, columns: Sequence[str] | None = None, exact: bool | None = None) -> DataFrame:
    """Fill with the exact (linear-interpolated) median."""
    cols = columns_with_nulls(df, list(columns) if columns is not None else numeric_columns(df))
    return _fill(_as_double(df, cols), column_medians(df, cols, exact))


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _fill(df, column_modes(df, columns_with_nulls(df, list(columns))))


def impute_constant(df: DataFrame, values: dict) -> DataFrame:
    """Fill given columns with constants (the UI defaults are 0.0 and 'Unknown')."""
    return _fill(df, values)


def impute_mean_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns take the mean, every other column the mode, and
    ``'Unknown'`` when a column has no value at all."""
    cols = columns_with_nulls(df, list(columns) if columns is not None else list(df.columns))
    numeric = set(numeric_columns(df))
    num = [c for c in cols if c in numeric]
    other = [c for c in cols if c not in numeric]
    vals = column_means(df, num)
    modes = column_modes(df, other)
    for c in other:
        vals[c] = modes[c] if modes[c] is not None else UNKNOWN
    return _fill(_as_double(df, num), vals)


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any null (on the joint features + label frame)."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def missing_ratio(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: share of missing cells among ``columns``."""
    cols = list(columns) if columns is not None else list(df.columns)
    tot = sum((F.count_if(q(c).isNull()) for c in cols), F.lit(0).cast("bigint"))
    return df.agg(tot.alias("n_missing"), F.count(F.lit(1)).alias("n_rows")).select(
        "n_missing", (F.col("n_rows") * len(cols)).alias("n_cells"),
        F.try_divide(F.col("n_missing"), F.col("n_rows") * len(cols)).alias("missing_ratio"))


def auto_strategy(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Auto policy: no nulls -> none; < 5 % of cells -> drop; < 30 % -> knn;
    otherwise mean_mode."""
    r = missing_ratio(df, columns)
    return r.select("n_missing", "missing_ratio", F.when(F.col("n_missing") == 0, "none")
                    .when(F.col("missing_ratio") < AUTO_DROP_BELOW, "drop")
                    .when(F.col("missing_ratio") < AUTO_KNN_BELOW, "knn")
                    .otherwise("mean_mode").alias("strategy"))


def impute_auto(df: DataFrame, columns: Sequence[str] | None = None, id_col: str | None = None) -> DataFrame:
    strategy = auto_strategy(df, columns).first()["strategy"]
    if strategy == "none":
        return df
    if strategy == "drop":
        return drop_nulls(df, columns)
    if strategy == "knn":
        from sparkwright.operators.knn import impute_knn
        if id_col is None:
            raise ValueError("knn imputation needs an id column")
        return impute_knn(df, id_col=id_col, columns=columns)
    return impute_mean_mode(df, columns)


# ordered fills (E9-E11): blocked scans, exact for any key skew
def ffill(df, column, order_by, partition_by=(), n_blocks=None):
    return ordered.ffill(df, column, order_by, partition_by, n_blocks)


def bfill(df, column, order_by, partition_by=(), n_blocks=None):
    return ordered.bfill(df, column, order_by, partition_by, n_blocks)


def interpolate_linear(df, column, order_by, partition_by=(), n_blocks=None):
    return ordered.interpolate_linear(df, column, order_by, partition_by, n_blocks)
