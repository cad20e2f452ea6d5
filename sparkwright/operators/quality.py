"""Validation report, column-name checks, target and preprocessing advice
(D5, D7, D18-D23).

Rules run on the driver over *profiles* (one row per column), never over rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.columns import (is_numeric, is_text, numeric_columns, pandas_dtype, q,
                                           text_columns, unpivot_row)
from sparkwright.operators import profile as P
from sparkwright.functions.columns import attach_one_row

# Name keywords that make a numeric column a binning candidate (fixed values).
BIN_KEYWORDS_ADVICE = ["age", "year", "price", "salary", "income"]
BIN_KEYWORDS = ["age", "year", "price", "salary", "income", "score", "rating", "amount",
                "distance", "duration"]

# Thresholds of the rules (fixed values).
HIGH_MISSING_PCT = 50.0
TEXT_TARGET_MIN, TEXT_TARGET_MAX = 2, 10
NUMERIC_TARGET_MAX = 20
CLASSIFICATION_MAX_DISTINCT = 20
CLASSIFICATION_MAX_RATIO = 0.05
BINNABLE_MIN_DISTINCT = 20
RARE_SHARE = 0.05


# --------------------------------------------------------------------- D5
def _unnamed(name: str) -> bool:
    # pandas names blank headers "Unnamed: i"; Spark's CSV reader names them "_c<i>"
    return name.startswith("Unnamed:") or (name.startswith("_c") and name[2:].isdigit())


def name_issues(names: list[str]) -> list[tuple[str, int]]:
    """``(issue, position)``: unnamed, duplicate (later occurrences) and
    names with characters other than letters, digits, ``_`` and space."""
    rows = [("unnamed", i) for i, n in enumerate(names) if _unnamed(n)]
    rows += [("duplicate", i) for i, n in enumerate(names) if n in names[:i]]
    return rows + [("special_characters", i) for i, n in enumerate(names)
                   if not n.replace("_", "").replace(" ", "").isalnum() and not _unnamed(n)]


def column_name_issues(df: DataFrame) -> DataFrame:
    """``(issue, column_name, n_values)``: the columns of ``name_issues`` with their cells that are not null,
    which tell a stray empty column from one that only needs a name.

    Names are schema metadata, judged on the driver; one aggregate counts the cells of the columns found.
    """
    found = name_issues(list(df.columns))
    return P.present_counts(df, [i for _, i in found], {
        "issue": [issue for issue, _ in found], "column_name": [df.columns[i] for _, i in found]})


# --------------------------------------------------------------------- D7
def validate_report(df: DataFrame, exact: bool | None = None) -> DataFrame:
    """Validation report as ``(kind, item, value)`` rows.

    kind is ``statistic``, ``warning`` or ``issue``; ``statistic/is_valid`` is
    1 or 0.  Built from the fused profile passes, so it costs four scans.
    """
    spark = df.sparkSession
    schema = "kind string, item string, value double"
    if len(df.columns) == 0 or df.isEmpty():
        return spark.createDataFrame([("issue", "empty", 0.0), ("statistic", "is_valid", 0.0)], schema)
    shape = P.table_shape(df).first()
    miss = P.missing_summary(df).first()
    dup = P.duplicate_rows(df).first()["n_duplicates"]
    names = Counter(issue for issue, _ in name_issues(list(df.columns)))
    out_cols = P.outlier_stats(df, exact=exact).count() if numeric_columns(df) else 0
    rows = [("statistic", "n_rows", float(shape["n_rows"])),
            ("statistic", "n_cols", float(shape["n_cols"])),
            ("statistic", "total_missing", float(miss["total_missing"])),
            ("statistic", "total_missing_pct", float(miss["total_missing_pct"])),
            ("statistic", "duplicate_rows", float(dup)),
            ("statistic", "n_numeric_columns", float(len(numeric_columns(df)))),
            ("statistic", "n_text_columns", float(len(text_columns(df)))),
            ("statistic", "n_outlier_columns", float(out_cols)),
            ("statistic", "is_valid", 1.0)]
    if miss["total_missing_pct"] > HIGH_MISSING_PCT:
        rows.append(("warning", "high_missing", float(miss["total_missing_pct"])))
    if dup > 0:
        rows.append(("warning", "duplicate_rows", float(dup)))
    for issue, n in names.items():
        rows.append(("warning", issue + "_columns", float(n)))
    return spark.createDataFrame(rows, schema)


# --------------------------------------------------------------------- D18
def suggest_targets(df: DataFrame) -> DataFrame:
    """Text columns with 2-10 distinct values, numeric ones with <= 20."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cand = [c for c in df.columns if is_text(types[c]) or is_numeric(types[c])]
    nu = P.nunique(df, cand)
    kinds = df.sparkSession.createDataFrame(
        [(c, "text" if is_text(types[c]) else "numeric", pandas_dtype(types[c])) for c in cand],
        "column_name string, kind string, dtype string")
    j = nu.join(F.broadcast(kinds), "column_name")
    rule = (((F.col("kind") == "text") & F.col("n_unique").between(TEXT_TARGET_MIN, TEXT_TARGET_MAX)) |
            ((F.col("kind") == "numeric") & (F.col("n_unique") <= NUMERIC_TARGET_MAX)))
    return j.where(rule).select("column_name", "dtype", "n_unique")


# --------------------------------------------------------------------- D19/D20
def column_profile(df: DataFrame, exact: bool | None = None) -> DataFrame:
    """Everything the advice rules read, one row per column, from fused passes:
    missing %, distinct count, bias-corrected skew, IQR outlier count and the
    number of rare categories."""
    names = list(df.columns)
    num = numeric_columns(df)
    txt = text_columns(df)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(names):
        aggs.append(F.count_if(q(c).isNull()).alias(f"__m{i}"))
        aggs.append((P.skew_expr(q(c)) if c in num else F.lit(None).cast("double")).alias(f"__k{i}"))
    r = range(len(names))
    base = unpivot_row(df.agg(*aggs), names, {
        "missing": [f"__m{i}" for i in r], "skew": [f"__k{i}" for i in r], "n_rows": ["__n"] * len(names)}) \
        .join(P.nunique(df, names), "column_name")
    if num:
        outl = P.outlier_stats(df, num, exact=exact, only_outliers=False).select("column_name", "n_outliers")
    else:
        outl = df.sparkSession.createDataFrame([], "column_name string, n_outliers bigint")
    if txt:
        rare = P.rare_category_count(df, txt, RARE_SHARE).select("column_name", "n_rare")
    else:
        rare = df.sparkSession.createDataFrame([], "column_name string, n_rare bigint")
    types = P.column_types(df)
    return base.join(F.broadcast(types), "column_name") \
        .join(F.broadcast(outl), "column_name", "left") \
        .join(F.broadcast(rare), "column_name", "left") \
        .select("column_name", "dtype", "type_class", "n_rows", "missing",
                F.try_divide(F.col("missing") * 100.0, F.col("n_rows")).alias("missing_pct"),
                "n_unique", "skew", "n_outliers", "n_rare")


def _advice_expr() -> "F.Column":
    num = F.col("type_class") == "numeric"
    txt = F.col("type_class") == "text"
    skew = F.coalesce(F.col("skew"), F.lit(0.0))
    name = F.lower(F.col("column_name"))
    kw = F.lit(False)
    for k in BIN_KEYWORDS_ADVICE:
        kw = kw | name.contains(k)
    parts = [
        F.when(F.col("missing_pct") > HIGH_MISSING_PCT, F.lit("impute:drop_column"))
         .when((F.col("missing_pct") > 0) & num & (skew > 1), F.lit("impute:median"))
         .when((F.col("missing_pct") > 0) & num, F.lit("impute:mean"))
         .when(F.col("missing_pct") > 0, F.lit("impute:mode")),
        F.when(num & kw, F.lit("bin")),
        F.when(num & (F.abs(skew) > 1), F.lit("transform:log_sqrt")),
        F.when(num & (F.col("n_outliers") > 0),
               F.concat(F.lit("clip:"), F.col("n_outliers").cast("string"), F.lit("_outliers"))),
        F.when(num, F.lit("scale")),
        F.when(txt & (F.col("n_unique") == 2), F.lit("encode:binary"))
         .when(txt & (F.col("n_unique") > 10),
               F.concat(F.lit("encode:label_or_frequency:"), F.col("n_unique").cast("string")))
         .when(txt, F.lit("encode:onehot")),
        F.when(txt & (F.col("n_rare") > 0),
               F.concat(F.lit("group_rare:"), F.col("n_rare").cast("string"))),
    ]
    joined = F.concat_ws(" | ", *parts)
    return F.when(joined == "", F.lit("none")).otherwise(joined)


def suggest_preprocessing(df: DataFrame, exact: bool | None = None) -> DataFrame:
    """``(column_name, advice)``; advice codes joined by `` | ``."""
    return column_profile(df, exact).select("column_name", _advice_expr().alias("advice"))


def binnable_columns(df: DataFrame) -> DataFrame:
    """Name has a binning keyword, or numeric with more than 20 distinct values."""
    nu = P.nunique(df)
    types = P.column_types(df)
    name = F.lower(F.col("column_name"))
    kw = F.lit(False)
    for k in BIN_KEYWORDS:
        kw = kw | name.contains(k)
    return nu.join(F.broadcast(types), "column_name").select(
        "column_name", (kw | ((F.col("type_class") == "numeric") &
                              (F.col("n_unique") > BINNABLE_MIN_DISTINCT))).alias("binnable"))


# --------------------------------------------------------------------- D21-D23
def task_type(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per candidate target: distinct count, rows, and both task rules
    (text -> classification; numeric: distinct < 20 or distinct/rows < 0.05;
    the custom-mode rule uses distinct < 20 only)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    nu = attach_one_row(P.nunique(df, columns), P.row_count(df))
    kinds = df.sparkSession.createDataFrame(
        [(c, is_text(types[c])) for c in columns], "column_name string, is_text boolean")
    j = nu.join(F.broadcast(kinds), "column_name")
    ratio = F.try_divide("n_unique", "n_rows")
    return j.select(
        "column_name", "n_unique", "n_rows", ratio.alias("unique_ratio"),
        (F.col("is_text") | (F.col("n_unique") < CLASSIFICATION_MAX_DISTINCT) |
         (ratio < CLASSIFICATION_MAX_RATIO)).alias("is_classification"),
        (F.col("is_text") | (F.col("n_unique") < CLASSIFICATION_MAX_DISTINCT)).alias("is_classification_custom"))


def is_classification(df: DataFrame, target: str, ratio_rule: bool = True) -> bool:
    r = task_type(df, [target]).first()
    return bool(r["is_classification"] if ratio_rule else r["is_classification_custom"])


def target_info(df: DataFrame, target: str) -> DataFrame:
    """Original dtype, distinct count, task, whether the target needs coding and, for a text target, its classes
    in the order of their codes (joined by ``|``)."""
    dt = df.schema[target].dataType
    t = task_type(df, [target])
    if is_text(dt):   # the class list is the answer itself
        classes = df.agg(F.array_join(F.sort_array(F.collect_set(q(target))), "|").alias("classes"))
    else:
        classes = df.sparkSession.range(1).agg(F.max(F.lit(None).cast("string")).alias("classes"))
    return attach_one_row(t, classes).select(
        "column_name", F.lit(pandas_dtype(dt)).alias("original_dtype"), "n_unique",
        F.when(F.col("is_classification"), "classification").otherwise("regression").alias("task_type"),
        F.lit(is_text(dt)).alias("needs_encoding"), "classes")
