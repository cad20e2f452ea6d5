"""Whole-column profiling.

Every scalar statistic of a pass is fused into one ``agg`` (partial
aggregation on the map side, one tiny final task), then unpivoted to long
format ``(column_name, metric...)`` without going through the driver.
Per-value counts use ``groupBy`` so they shuffle by value, never into one
task; row totals are joined back as a broadcast one-row frame.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.columns import (attach_one_row, distinct_counts, numeric_columns,
                                           pandas_dtype, q, quantile_set, text_columns,
                                           unpivot_row, value_tallies)
from sparkwright.session import ship_package


def _names(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return list(columns) if columns is not None else list(df.columns)


def row_count(df: DataFrame) -> DataFrame:
    """One-row frame ``n_rows`` (to be broadcast-joined where a total is needed)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


# --------------------------------------------------------------------- D1
def table_shape(df: DataFrame) -> DataFrame:
    n_cols = len(df.columns)
    return row_count(df).select(
        "n_rows", F.lit(n_cols).cast("bigint").alias("n_cols"),
        ((F.col("n_rows") == 0) | F.lit(n_cols == 0)).alias("is_empty"))


def is_empty(df: DataFrame) -> bool:
    return len(df.columns) == 0 or df.isEmpty()


# --------------------------------------------------------------------- D2
def _missing_agg(df: DataFrame, names: list[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count_if(q(c).isNull()).alias(f"__m{i}") for i, c in enumerate(names)])


def profile_missing(df: DataFrame, columns: Sequence[str] | None = None,
                    only_missing: bool = True) -> DataFrame:
    """Per column: missing count, % of rows, all-missing flag (only count > 0)."""
    names = _names(df, columns)
    agg = _missing_agg(df, names)
    long = unpivot_row(agg.select("*"), names,
                       {"missing_count": [f"__m{i}" for i in range(len(names))],
                        "n_rows": ["__n"] * len(names)})
    out = long.select(
        "column_name", "missing_count",
        F.try_divide(F.col("missing_count") * 100.0, F.col("n_rows")).alias("missing_pct"),
        (F.col("missing_count") == F.col("n_rows")).alias("all_missing"))
    return out.where(F.col("missing_count") > 0) if only_missing else out


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Totals over all cells: total missing and its share of rows x columns."""
    names = _names(df, columns)
    agg = _missing_agg(df, names)
    total = sum((F.col(f"__m{i}") for i in range(len(names))), F.lit(0).cast("bigint"))
    n_cells = F.col("__n") * F.lit(len(names))
    return agg.select(
        n_cells.alias("total_cells"), total.alias("total_missing"),
        F.try_divide(total * 100.0, n_cells).alias("total_missing_pct"),
        sum((F.when(F.col(f"__m{i}") > 0, 1).otherwise(0) for i in range(len(names))),
            F.lit(0)).cast("bigint").alias("n_columns_with_missing"),
        sum((F.when(F.col(f"__m{i}") == F.col("__n"), 1).otherwise(0)
             for i in range(len(names))), F.lit(0)).cast("bigint").alias("n_all_missing_columns"))


# --------------------------------------------------------------------- D3
def present_counts(df: DataFrame, positions: Sequence[int], labels: dict[str, Sequence[str]]) -> DataFrame:
    """One row per given column position: its ``labels`` and ``n_values``, the cells that are not null.

    Columns are taken by position, so names may repeat; one aggregate over the table, unpivoted on its one row.
    """
    if not positions:
        return df.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in labels) + ", n_values long")
    by_place = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    counts = by_place.agg(*[F.count(f"__c{i}").alias(f"__n{i}") for i in sorted(set(positions))])
    return counts.select(F.inline(F.array(*[
        F.struct(*[F.lit(texts[k]).alias(c) for c, texts in labels.items()], F.col(f"__n{i}").alias("n_values"))
        for k, i in enumerate(positions)])))


def profile_dtypes(df: DataFrame) -> DataFrame:
    """Column-type distribution by pandas dtype name: columns of the type, and their cells that are not null.

    A table without columns gives no rows; one without rows gives its types with no values."""
    types = [pandas_dtype(f.dataType) for f in df.schema.fields]
    return present_counts(df, range(len(types)), {"dtype": types}).groupBy("dtype").agg(
        F.count(F.lit(1)).alias("n_columns"), F.sum("n_values").alias("n_values"))


def column_types(df: DataFrame) -> DataFrame:
    """Per column: pandas dtype and type class (numeric / text / datetime / other)."""
    from sparkwright.functions.columns import is_datetime, is_numeric, is_text
    rows = []
    for f in df.schema.fields:
        cls = ("numeric" if is_numeric(f.dataType) else "text" if is_text(f.dataType)
               else "datetime" if is_datetime(f.dataType) else "other")
        rows.append((f.name, pandas_dtype(f.dataType), cls))
    return df.sparkSession.createDataFrame(rows, "column_name string, dtype string, type_class string")


# --------------------------------------------------------------------- D4
def _row_hashes(df: DataFrame) -> list:
    cols = [q(c) for c in df.columns]
    nulls = [c.isNull() for c in cols]   # xxhash64 skips nulls: hash their positions too
    return [F.xxhash64(*cols, *nulls).alias("__h1"),
            F.xxhash64(F.lit("sparkwright"), *cols, *nulls).alias("__h2")]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows identical to an earlier row (nulls equal).

    Rows are reduced to a 128-bit fingerprint before the shuffle, so wide rows
    (long texts) never travel; the map-side partial aggregate collapses hot
    duplicate groups before they are shuffled.
    """
    fp = df.select(*_row_hashes(df))
    per_fp = fp.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("c"))
    tot = per_fp.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("n_rows"),
                     F.count(F.lit(1)).alias("n_distinct"))
    return tot.select("n_rows", "n_distinct", (F.col("n_rows") - F.col("n_distinct")).alias("n_duplicates"))


def duplicate_mask(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Flag every row that repeats an earlier row in ``order_by`` order (keep='first')."""
    h = df.select("*", *_row_hashes(df))
    first = h.groupBy("__h1", "__h2").agg(F.min(F.struct(*[q(c) for c in order_by])).alias("__first"))
    out = h.join(first, ["__h1", "__h2"], "left")
    return out.select(*[q(c) for c in df.columns],
                      (F.struct(*[q(c) for c in order_by]) != F.col("__first")).alias("is_duplicate"))


# --------------------------------------------------------------------- D6
def outlier_bounds(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5,
                   exact: bool | None = None) -> DataFrame:
    """One row per numeric column: Q1, Q3 (linear interpolation) and fences."""
    names = list(columns) if columns is not None else numeric_columns(df)
    found = quantile_set(df, [(q(c), [0.25, 0.75]) for c in names], exact)
    agg = df.agg(*[p.alias(f"__p{i}") for i, p in enumerate(found)])
    long = unpivot_row(agg, names, {"qs": [f"__p{i}" for i in range(len(names))]})
    return long.select(
        "column_name", F.col("qs")[0].alias("q1"), F.col("qs")[1].alias("q3")) \
        .withColumn("lower_bound", F.col("q1") - F.lit(k) * (F.col("q3") - F.col("q1"))) \
        .withColumn("upper_bound", F.col("q3") + F.lit(k) * (F.col("q3") - F.col("q1")))


def outlier_stats(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5,
                  exact: bool | None = None, only_outliers: bool = True) -> DataFrame:
    """IQR outliers: strict ``<`` lower / ``>`` upper; % of all rows."""
    names = list(columns) if columns is not None else numeric_columns(df)
    bounds = outlier_bounds(df, names, k, exact).collect()  # one row per column: bounded
    b = {r["column_name"]: r for r in bounds}
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(names):
        lo, hi = b[c]["lower_bound"], b[c]["upper_bound"]
        if lo is None:
            aggs.append(F.lit(0).cast("bigint").alias(f"__o{i}"))
        else:
            aggs.append(F.count_if((q(c) < F.lit(lo)) | (q(c) > F.lit(hi))).alias(f"__o{i}"))
    counts = df.agg(*aggs)
    long = unpivot_row(counts, names, {"n_outliers": [f"__o{i}" for i in range(len(names))],
                                       "n_rows": ["__n"] * len(names)})
    bdf = outlier_bounds_frame(df, bounds)
    out = long.join(F.broadcast(bdf), "column_name").select(
        "column_name", "q1", "q3", "lower_bound", "upper_bound", "n_outliers",
        (F.col("n_outliers") * 100.0 / F.col("n_rows")).alias("outlier_pct"))
    return out.where(F.col("n_outliers") > 0) if only_outliers else out


def outlier_bounds_frame(df: DataFrame, rows) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(r["column_name"], r["q1"], r["q3"], r["lower_bound"], r["upper_bound"]) for r in rows],
        "column_name string, q1 double, q3 double, lower_bound double, upper_bound double")


# --------------------------------------------------------------------- D8
def describe(df: DataFrame, columns: Sequence[str] | None = None, exact: bool | None = None) -> DataFrame:
    """count, mean, std (n-1), min, 25/50/75 % (linear), max per numeric column."""
    names = list(columns) if columns is not None else numeric_columns(df)
    aggs = []
    found = quantile_set(df, [(q(c), [0.25, 0.5, 0.75]) for c in names], exact)
    for i, c in enumerate(names):
        x = q(c).cast("double")
        aggs += [F.count(x).alias(f"__c{i}"), F.avg(x).alias(f"__a{i}"),
                 F.stddev_samp(x).alias(f"__s{i}"), F.min(x).alias(f"__mn{i}"), found[i].alias(f"__p{i}"),
                 F.max(x).alias(f"__mx{i}")]
    r = range(len(names))
    long = unpivot_row(df.agg(*aggs), names, {
        "count": [f"__c{i}" for i in r], "mean": [f"__a{i}" for i in r],
        "std": [f"__s{i}" for i in r], "min": [f"__mn{i}" for i in r],
        "qs": [f"__p{i}" for i in r], "max": [f"__mx{i}" for i in r]})
    return long.select("column_name", "count", "mean", "std", "min",
                       F.col("qs")[0].alias("p25"), F.col("qs")[1].alias("p50"),
                       F.col("qs")[2].alias("p75"), "max")


# --------------------------------------------------------------------- D9
def nunique(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True,
            rsd: float = 0.01) -> DataFrame:
    """Distinct non-null values per column (exact, or HyperLogLog++ at scale)."""
    names = _names(df, columns)
    if exact:
        return distinct_counts(df, names)
    aggs = [F.approx_count_distinct(q(c), rsd).alias(f"__u{i}") for i, c in enumerate(names)]
    return unpivot_row(df.agg(*aggs), names, {"n_unique": [f"__u{i}" for i in range(len(names))]})


# --------------------------------------------------------------------- D10
def mode_frame(df: DataFrame, column: str) -> DataFrame:
    """One-row frame ``mode``: most frequent non-null value, smallest on ties.

    Counts are a ``groupBy`` (map-side combined, shuffled by value); the pick
    is a global min over ``(-count, value)``: no value map in one task.
    """
    counts = df.where(q(column).isNotNull()).groupBy(q(column).alias("v")).count()
    best = counts.agg(F.min(F.struct((-F.col("count")).alias("k"), F.col("v"))).alias("m"))
    return best.select(F.col("m.v").alias("mode"))


def mode_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(i, v, o)``: the mode of each column (by number) as text and, if numeric, as a double; smallest value on ties.

    All columns in one pass: values travel as text beside a number that orders numeric ones, and counts are combined in
    the map tasks.  Columns without values give no row.
    """
    numeric = set(numeric_columns(df))
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), q(c).cast("string").alias("v"),
                               (q(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("o"))
                      for i, c in enumerate(columns)])
    counts = df.select(F.inline(pairs)).where("v IS NOT NULL").groupBy("i", "v", "o").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("n"), "o", "v")).alias("m"))   # one row per column
    return best.select("i", "m.v", "m.o")


def mode_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long format ``column_name, mode_text, mode_number`` for the given columns (nulls without values)."""
    numeric = set(numeric_columns(df))
    names = df.sparkSession.createDataFrame([(i, c, c in numeric) for i, c in enumerate(columns)],
                                            "i int, column_name string, is_number boolean")
    return names.join(mode_table(df, columns), "i", "left").select(
        "column_name", F.when(~F.col("is_number"), F.col("v")).alias("mode_text"), F.col("o").alias("mode_number"))


# --------------------------------------------------------------------- D12
def skewness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bias-corrected sample skewness G1 = g1 * sqrt(n(n-1)) / (n-2)."""
    names = list(columns) if columns is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(names):
        x = q(c).cast("double")
        n = F.count(x).cast("double")
        aggs.append(F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)).alias(f"__k{i}"))
    return unpivot_row(df.agg(*aggs), names, {"skewness": [f"__k{i}" for i in range(len(names))]})


def skew_expr(c) -> "F.Column":
    x = c.cast("double")
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


# --------------------------------------------------------------------- D13/D14/D15
def value_counts(df: DataFrame, column: str, normalize_by: str = "rows") -> DataFrame:
    """Non-null value counts with a share: of all rows (``rows``) or of non-null
    values (``non_null``)."""
    counts = df.where(q(column).isNotNull()).groupBy(q(column).alias("value")) \
        .agg(F.count(F.lit(1)).alias("count"))
    if normalize_by == "rows":
        total = row_count(df).select(F.col("n_rows").alias("__t"))
    else:
        total = df.agg(F.count(q(column)).alias("__t"))
    return attach_one_row(counts, total).select(
        "value", "count", (F.col("count") * 100.0 / F.col("__t")).alias("pct"))


def value_freq(df: DataFrame, column: str) -> DataFrame:
    """Normalised value counts over non-null values (fractions)."""
    return value_counts(df, column, "non_null").select(
        "value", "count", (F.col("pct") / 100.0).alias("freq"))


def rare_category_count(df: DataFrame, columns: Sequence[str] | None = None,
                        threshold: float = 0.05) -> DataFrame:
    """Per text column: number of categories whose non-null share is < threshold."""
    names = list(columns) if columns is not None else text_columns(df)
    tallies = value_tallies(df, names)
    totals = tallies.groupBy("column_name").agg(F.sum("tally").alias("total"))   # one row per column
    found = tallies.join(F.broadcast(totals), "column_name").groupBy("column_name").agg(
        F.count_if(F.col("tally") / F.col("total") < threshold).alias("n_rare"), F.count(F.lit(1)).alias("n_categories"))
    frame = df.sparkSession.createDataFrame([(c,) for c in names], "column_name string")
    return frame.join(found, "column_name", "left").select(
        "column_name", F.coalesce("n_rare", F.lit(0)).alias("n_rare"), F.coalesce("n_categories", F.lit(0)).alias("n_categories"))


# --------------------------------------------------------------------- D16
def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram: left-closed bins, last bin closed; a constant
    column is centred in a unit range like the plotting library does."""
    x = q(column).cast("double")
    rng = df.agg(F.min(x).alias("__mn"), F.max(x).alias("__mx")).select(
        F.when(F.col("__mn") == F.col("__mx"), F.col("__mn") - 0.5).otherwise(F.col("__mn")).alias("lo"),
        F.when(F.col("__mn") == F.col("__mx"), F.col("__mx") + 0.5).otherwise(F.col("__mx")).alias("hi"))
    b = F.least(F.floor((x - F.col("lo")) * F.lit(bins) / (F.col("hi") - F.col("lo"))),
                F.lit(bins - 1)).cast("int")
    counts = attach_one_row(df.where(x.isNotNull()), rng).groupBy(b.alias("bin")) \
        .agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    w = (F.col("hi") - F.col("lo")) / F.lit(bins)
    return grid.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * w).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + 1) * w).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


# --------------------------------------------------------------------- D17
def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation (pairwise complete, NaN counts as missing) for every pair below the diagonal.

    Each task folds its rows into four products of columns by columns: counts, sums, squares and
    cross-products of the centred values over the rows where both are there.  Null without spread.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    c = len(names)
    if c < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    ship_package(df.sparkSession)
    values = df.select(*[q(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)])
    first = values.agg(*[F.avg(F.when(~F.isnan(x), F.col(x))).alias(x) for x in values.columns]).first()
    centre = np.array([0.0 if v is None else v for v in first])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, c, c))
        for batch in batches:
            x = np.column_stack([np.asarray(v.to_numpy(zero_copy_only=False), dtype=float) for v in batch.columns]) - centre
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(total.size)), "v": pa.array(total.ravel())})

    sums = values.mapInArrow(fold, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    total = np.zeros(4 * c * c)
    for at, v in sums.collect():                    # 4 x columns^2 numbers
        total[at] = v
    n, s, ss, sp = total.reshape(4, c, c)
    rows = []
    for i in range(c):
        for j in range(i):
            k = n[i, j]
            spread = (k * ss[i, j] - s[i, j] ** 2) * (k * ss[j, i] - s[j, i] ** 2)
            rows.append((names[i], names[j], float((k * sp[i, j] - s[i, j] * s[j, i]) / np.sqrt(spread)) if spread > 0 else None))
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")


# --------------------------------------------------------------------- B14/D24
def column_info(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: dtype, non-null count, null count, distinct count, missing %."""
    names = list(df.columns)
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count(q(c)).alias(f"__nn{i}") for i, c in enumerate(names)]
    long = unpivot_row(df.agg(*aggs), names, {"non_null": [f"__nn{i}" for i in range(len(names))],
                                              "n_rows": ["__n"] * len(names)})
    types = column_types(df).select("column_name", "dtype")
    return long.join(nunique(df, names, exact), "column_name").join(F.broadcast(types), "column_name").select(
        "column_name", "dtype", "non_null",
        (F.col("n_rows") - F.col("non_null")).alias("null_count"), "n_unique",
        F.try_divide((F.col("n_rows") - F.col("non_null")) * 100.0, F.col("n_rows")).alias("missing_pct"))
