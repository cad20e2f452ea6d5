"""Categorical encodings and lookups.

Dictionaries (value -> code / frequency) are DataFrames, never driver
lists: codes come from a distributed rank over the range-partitioned
distinct values, and the dictionary is joined back (broadcast only where the
optimizer's byte sizes allow).  One-hot is the exception: its output schema
*is* the category list, so it is collected; a caller may bound it with
``max_categories``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.columns import q, text_columns
from sparkwright.operators.ordered import row_position
from sparkwright.functions.columns import attach_one_row
from sparkwright.session import cut_lineage

NAN_TEXT = "nan"            # text of a missing value once cast to text (fixed value)
OTHER = "Other"             # replacement for rare categories (fixed value)
BROADCAST_BYTES = 16 << 20  # most counted bytes of a dictionary that every task gets


def as_text(c) -> "F.Column":
    """Cast to text; a missing value becomes the literal ``nan``."""
    return F.coalesce(c.cast("string"), F.lit(NAN_TEXT))


def _join_dict(df: DataFrame, d: DataFrame, on: str) -> DataFrame:
    """Look up a dictionary; it is broadcast if its counted bytes allow, so rows of a frequent value stay in their own tasks."""
    d = cut_lineage(d)
    size = d.agg(F.sum(F.octet_length(q(on).cast("string"))), F.count(F.lit(1))).first()
    return df.join(F.broadcast(d) if (size[0] or 0) + 32 * size[1] <= BROADCAST_BYTES else d, on, "left")


def dense_codes(values: DataFrame, col: str = "value", code: str = "code",
                n_blocks: int | None = None) -> DataFrame:
    """0-based dense rank of the distinct ``values[col]`` in ascending order.

    Distributed: the distinct values are numbered blockwise (see
    ``ordered.row_position``) - no single-task window over all values.
    """
    d = values.select(q(col).alias(col)).distinct()
    pos = row_position(d, [col], n_blocks=n_blocks, name=code)
    return pos.select(q(col), F.col(code).cast("bigint").alias(code))


# --------------------------------------------------------------------- F1 / F6
def label_dictionary(df: DataFrame, column: str) -> DataFrame:
    """``(value, code)`` over the sorted distinct text values (missing -> 'nan')."""
    return dense_codes(df.select(as_text(q(column)).alias("value")))


def label_dictionaries(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, value, code, real)`` of several columns at once; ``real`` tells whether a value occurs
    other than as the text of a missing one."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), as_text(q(c)).alias("value"), q(c).isNotNull().alias("real"))
                      for c in columns])
    values = df.select(F.inline(pairs)).groupBy("column_name", "value").agg(F.max("real").alias("real"))
    return row_position(values, ["value"], ["column_name"], name="code") \
        .select("column_name", "value", F.col("code").cast("bigint").alias("code"), "real")


def encode_label(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """Replace each column by the code of its text value in sorted order
    (or add ``<col><suffix>`` when a suffix is given)."""
    out = df
    for c in columns:
        d = label_dictionary(out, c)
        key, code = f"__lk_{c}", f"__lc_{c}"
        d = d.select(F.col("value").alias(key), F.col("code").alias(code))
        j = _join_dict(out.withColumn(key, as_text(q(c))), d, key)
        if suffix:
            out = j.select(*[q(x) for x in out.columns], F.col(code).alias(c + suffix))
        else:
            out = j.select(*[F.col(code).alias(x) if x == c else q(x) for x in out.columns])
    return out


def encode_target(df: DataFrame, target: str) -> DataFrame:
    """Text target -> integer codes (sorted classes); numeric targets unchanged."""
    if target not in text_columns(df):
        return df
    return encode_label(df, [target])


# --------------------------------------------------------------------- F2
def category_list(df: DataFrame, column: str, max_categories: int | None = None) -> list:
    """Sorted distinct non-null values (they become output columns); more than a caller's
    ``max_categories`` are refused."""
    d = df.where(q(column).isNotNull()).select(q(column).alias("v")).distinct()
    vals = [r["v"] for r in (d if max_categories is None else d.limit(max_categories + 1)).collect()]
    if max_categories is not None and len(vals) > max_categories:
        raise ValueError(f"{column}: more than {max_categories} categories for one-hot")
    return sorted(vals)


def _dummy_name(col: str, v) -> str:
    return f"{col}_{v}"


def encode_onehot(df: DataFrame, columns: Sequence[str],
                  categories: dict | None = None) -> DataFrame:
    """``<col>_<value>`` 0/1 integer columns (sorted, no level dropped; a
    missing value is all zeros), appended after the remaining columns."""
    cats = dict(categories or {})
    for c in columns:
        if c not in cats:
            cats[c] = category_list(df, c)
    keep = [q(x) for x in df.columns if x not in set(columns)]
    dummies = []
    for c in columns:
        for v in cats[c]:
            dummies.append(F.when(q(c) == F.lit(v), 1).otherwise(0).alias(_dummy_name(c, v)))
    return df.select(*keep, *dummies)


def encode_by_cardinality(df: DataFrame, columns: Sequence[str] | None = None,
                          onehot_max: int = 10) -> tuple[DataFrame, dict]:
    """One-hot when the column has <= ``onehot_max`` distinct values, else label.

    ``onehot_max=10`` is the ``onehot`` strategy, ``5`` the ``auto``/mixed one.
    Returns the frame and the per-column choice.
    """
    from sparkwright.operators.profile import nunique
    cols = list(columns) if columns is not None else text_columns(df)
    if not cols:
        return df, {}
    nu = {r["column_name"]: r["n_unique"] for r in nunique(df, cols).collect()}
    onehot = [c for c in cols if nu[c] <= onehot_max]
    label = [c for c in cols if nu[c] > onehot_max]
    out = encode_label(df, label) if label else df
    out = encode_onehot(out, onehot) if onehot else out
    return out, {**{c: "onehot" for c in onehot}, **{c: "label" for c in label}}


# --------------------------------------------------------------------- F5 / C1
def frequency_dictionary(df: DataFrame, column: str) -> DataFrame:
    """``(value, freq)``: share of each value among non-null values."""
    counts = df.where(q(column).isNotNull()).groupBy(q(column).alias("value")).count()
    tot = df.agg(F.count(q(column)).alias("__t"))
    return attach_one_row(counts, tot).select(
        "value", (F.col("count") / F.col("__t")).alias("freq"))


def frequency_dictionaries(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, value, freq)`` of several columns at once."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), q(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("column_name", "value").count()
    totals = counts.groupBy("column_name").agg(F.sum("count").alias("total"))      # one row per column
    return counts.join(F.broadcast(totals), "column_name").select("column_name", "value", (F.col("count") / F.col("total")).alias("freq"))


def encode_frequency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each value by its non-null frequency (missing stays missing)."""
    out = df
    for c in columns:
        d = frequency_dictionary(out, c)
        key = f"__fk_{c}"
        d = d.withColumnRenamed("value", key).withColumnRenamed("freq", f"__f_{c}")
        j = _join_dict(out.withColumn(key, q(c)), d, key)
        out = j.select(*[F.col(f"__f_{c}").alias(x) if x == c else q(x) for x in out.columns])
    return out


# --------------------------------------------------------------------- F7 / C2
def rare_to_other(df: DataFrame, columns: Sequence[str], threshold_pct: float = 5.0) -> DataFrame:
    """Values whose non-null share is below ``threshold_pct`` % become ``'Other'``."""
    out = df
    for c in columns:
        d = frequency_dictionary(out, c).where(F.col("freq") < threshold_pct / 100.0).select(
            F.col("value").alias(f"__rk_{c}"), F.lit(True).alias(f"__rare_{c}"))
        j = _join_dict(out.withColumn(f"__rk_{c}", q(c)), d, f"__rk_{c}")
        out = j.select(*[F.when(F.col(f"__rare_{c}"), F.lit(OTHER)).otherwise(q(x)).alias(x)
                         if x == c else q(x) for x in out.columns])
    return out


def drop_rare(df: DataFrame, column: str, threshold_pct: float = 5.0) -> DataFrame:
    """Rows whose value is rare are removed (left-anti join to the rare set)."""
    d = frequency_dictionary(df, column).where(F.col("freq") < threshold_pct / 100.0) \
        .select(F.col("value").alias("__rk"))
    return df.join(d, q(column) == F.col("__rk"), "left_anti")
