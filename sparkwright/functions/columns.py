"""Type gates, NaN normalisation and small column-expression helpers.

The type gates read only the schema (driver metadata), never the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.session import cut_lineage

# pandas-style dtype names reported by the profile (fixed values).
_PANDAS_DTYPE = {
    T.LongType: "int64",
    T.IntegerType: "int32",
    T.ShortType: "int16",
    T.ByteType: "int8",
    T.DoubleType: "float64",
    T.FloatType: "float32",
    T.StringType: "object",
    T.BooleanType: "bool",
    T.TimestampType: "datetime64[ns]",
    T.TimestampNTZType: "datetime64[ns]",
    T.DateType: "datetime64[ns]",
    T.DecimalType: "float64",
}

APPROX_ACCURACY = 1_000_000

# Types whose 64-bit hash is one-to-one (values of at most eight bytes).
_FIXED = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.BooleanType,
          T.DateType, T.TimestampType, T.TimestampNTZType)


def pandas_dtype(dt: T.DataType) -> str:
    for cls, name in _PANDAS_DTYPE.items():
        if isinstance(dt, cls):
            return name
    return dt.simpleString()


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in ex]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if is_text(f.dataType) and f.name not in ex]


def datetime_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if is_datetime(f.dataType) and f.name not in ex]


def col_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def q(name: str) -> Column:
    """Column reference that tolerates any character in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def normalize_missing(df: DataFrame) -> DataFrame:
    """Turn float NaN into null once, so ``isNull`` is the single missing test.

    Decimal columns are cast to double (the profile treats them as numbers).
    """
    out = []
    for f in df.schema.fields:
        c = q(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(~F.isnan(c), c).alias(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            out.append(c.cast("double").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


# ``percentile`` merges a value -> count map in one task.  It is used while the
# optimizer's estimate of the input stays below this; beyond, the same exact
# values come from ``ranked``.
ONE_TASK_BYTES = 64 * 1024 ** 2


def quantiles(df: DataFrame, c: Column, probs: Sequence[float], exact: bool | None = None) -> Column:
    """Array of linear-interpolated quantiles of ``c``, for an aggregation over ``df``.

    Exact at any size; ``exact=False`` is the caller's choice of approximate
    ones (which do not interpolate).
    """
    return quantile_set(df, [(c, probs)], exact)[0]


def quantile_set(df: DataFrame, wanted: Sequence[tuple[Column, Sequence[float]]],
                 exact: bool | None = None) -> list[Column]:
    """``quantiles`` of several columns; beyond one task's size they share one pass."""
    if not wanted:
        return []
    arrays = [F.array(*[F.lit(float(p)) for p in probs]) for _, probs in wanted]
    if exact is False:
        return [F.percentile_approx(c.cast("double"), a, APPROX_ACCURACY) for (c, _), a in zip(wanted, arrays)]
    if _estimated_bytes(df) <= ONE_TASK_BYTES:
        return [F.percentile(c.cast("double"), a) for (c, _), a in zip(wanted, arrays)]
    return [F.array(*[F.lit(v).cast("double") for v in values]) for values in ranked(df, wanted)]


def _estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df`` (no job is run)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def ranked(df: DataFrame, wanted: Sequence[tuple[Column, Sequence[float]]]) -> list[list[float | None]]:
    """Linear-interpolated quantiles of several columns by rank selection (null without values).

    Values become a distributed (column, value, count) table, combined in the map
    tasks, so ties of any size are one row.  It is cut into ranges; the ranges'
    totals, one row each, are cumulated and say which range holds a rank, and only
    there are the counts of single values cumulated.  The driver gets the asked
    values, at most two per quantile.
    """
    values = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), c.cast("double").alias("v"))
                                          for i, (c, _) in enumerate(wanted)]))).where("v IS NOT NULL")
    placed = cut_lineage(values.groupBy("i", "v").agg(F.count(F.lit(1)).alias("c")).repartitionByRange("i", "v")
                         .withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("i")
    blocks = placed.groupBy("i", "part").agg(F.sum("c").alias("total")).select(
        "i", "part", "total", F.sum("total").over(own).alias("n"),
        (F.sum("total").over(own.orderBy("part")) - F.col("total")).alias("before"))
    probs = F.array(*[F.array(*[F.lit(float(p)) for p in probs]) for _, probs in wanted])
    place = F.col("p") * (F.col("n") - 1)
    asked = blocks.withColumn("p", F.explode(F.element_at(probs, F.col("i") + 1))) \
        .withColumn("k", F.explode(F.array(F.floor(place), F.ceil(place)))) \
        .where("before <= k AND k < before + total").select("i", "part", "n", "k", "before").distinct()
    inside = Window.partitionBy("i", "part", "k").orderBy("v")
    found = placed.join(F.broadcast(asked), ["i", "part"]) \
        .withColumn("upto", F.col("before") + F.sum("c").over(inside)) \
        .where("upto > k AND upto - c <= k").select("i", "n", "k", "v").collect()
    at = {(r["i"], r["k"]): r["v"] for r in found}
    rows = {r["i"]: r["n"] for r in found}

    def value(i: int, p: float) -> float | None:
        if i not in rows:
            return None
        x = float(p) * (rows[i] - 1)
        lo, hi = at[i, math.floor(x)], at[i, math.ceil(x)]
        return lo + (x - math.floor(x)) * (hi - lo)
    return [[value(i, p) for p in probs] for i, (_, probs) in enumerate(wanted)]


# --------------------------------------------------------------------- distinct values
def value_tallies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, tally)``: one row per distinct non-null value of each column, and how often it occurs.

    Each row gives one narrow (column number, key) pair per column, counted in the map
    tasks before the shuffle; the row itself is not repeated.  The key of a fixed-width
    value is its 64-bit hash, which is one-to-one on such values; texts and other types
    are their own keys.
    """
    fixed, others = [], []
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType
        if isinstance(kind, _FIXED) or (isinstance(kind, T.DecimalType) and kind.precision <= 18):
            fixed.append(F.struct(F.lit(i).alias("i"), F.when(q(c).isNotNull(), F.xxhash64(q(c))).alias("key")))
        else:
            text = q(c) if is_text(kind) else F.hex(q(c)) if isinstance(kind, T.BinaryType) else \
                F.to_json(F.struct(q(c).alias("v"))) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) \
                else q(c).cast("string")
            others.append(F.struct(F.lit(i).alias("i"), F.when(q(c).isNotNull(), text).alias("key")))
    out = None
    for pairs in (fixed, others):
        if pairs:
            one = df.select(F.inline(F.array(*pairs))).where("key IS NOT NULL").groupBy("i", "key") \
                .agg(F.count(F.lit(1)).alias("tally")).select("i", "tally")
            out = one if out is None else out.unionByName(one)
    names = F.array(*[F.lit(c) for c in columns])
    return out.select(F.element_at(names, F.col("i") + 1).alias("column_name"), "tally")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, n_unique)`` for every column (0 without values)."""
    found = value_tallies(df, columns).groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(found, "column_name", "left").select("column_name", F.coalesce("n", F.lit(0)).alias("n_unique"))


def unpivot_row(df: DataFrame, names: Sequence[str], fields: dict[str, Sequence[str]],
                key: str = "column_name") -> DataFrame:
    """Turn a one-row frame of per-column metrics into long format.

    ``fields`` maps an output field name to the list of source column names
    (one per entry of ``names``).
    """
    structs = []
    for i, n in enumerate(names):
        parts = [F.lit(n).alias(key)]
        for out_name, srcs in fields.items():
            parts.append(F.col(srcs[i]).alias(out_name))
        structs.append(F.struct(*parts))
    return df.select(F.inline(F.array(*structs)))


def safe_name(i: int, tag: str) -> str:
    return f"__{tag}_{i}"


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a single-row aggregate to every row.

    ``one_row`` must be a global aggregate (exactly one row).  It is attached
    as one scalar subquery (evaluated once, its value shipped to the tasks as
    a constant), so there is no join at all and the plan stays lazy instead
    of collecting the scalars first.
    """
    cols = one_row.columns
    s = one_row.select(F.struct(*[q(c) for c in cols]).alias("__one")).scalar()
    return df.select("*", *[s.getField(c).alias(c) for c in cols])
