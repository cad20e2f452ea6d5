"""Input frames of the registered queries and their SQL twins.

Test tables have no nulls, so missing-value queries inject them with one
expression text that both Spark and the SQL oracle evaluate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Null-injection predicates per column (fixed values; shared with the oracle).
LINEITEM_NULLS = {
    "l_quantity": "(l_orderkey + l_linenumber) % 7 = 0",
    "l_extendedprice": "(l_orderkey + l_partkey) % 11 = 0",
    "l_discount": "(l_suppkey + l_linenumber) % 5 = 0",
    "l_returnflag": "(l_orderkey + l_suppkey) % 13 = 0",
}
LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"]

EVENTS_NULLS = {"value": "event_id % 9 = 0"}
EVENTS_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]

ORDERS_NULLS = {
    "o_totalprice": "o_orderkey % 17 = 0",
    "o_orderpriority": "(o_orderkey + o_custkey) % 19 = 0",
}
ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _null_exprs(cols, nulls) -> list[str]:
    return [f"CASE WHEN {nulls[c]} THEN NULL ELSE {c} END AS {c}" if c in nulls else c for c in cols]


def _with_nulls(spark, sf_dir, name, cols, nulls, keep=None) -> DataFrame:
    keep = keep or cols
    return table(spark, sf_dir, name).selectExpr(*_null_exprs(keep, nulls))


def _with_nulls_sql(name, cols, nulls, keep=None) -> str:
    keep = keep or cols
    return f"(SELECT {', '.join(_null_exprs(keep, nulls))} FROM {name})"


def lineitem_nulls(spark, sf_dir, keep=None) -> DataFrame:
    return _with_nulls(spark, sf_dir, "lineitem", LINEITEM_COLS, LINEITEM_NULLS, keep)


def lineitem_nulls_sql(keep=None) -> str:
    return _with_nulls_sql("lineitem", LINEITEM_COLS, LINEITEM_NULLS, keep)


def events_nulls(spark, sf_dir, keep=None) -> DataFrame:
    return _with_nulls(spark, sf_dir, "events", EVENTS_COLS, EVENTS_NULLS, keep)


def events_nulls_sql(keep=None) -> str:
    return _with_nulls_sql("events", EVENTS_COLS, EVENTS_NULLS, keep)


def orders_nulls(spark, sf_dir, keep=None) -> DataFrame:
    return _with_nulls(spark, sf_dir, "orders", ORDERS_COLS, ORDERS_NULLS, keep)


def orders_nulls_sql(keep=None) -> str:
    return _with_nulls_sql("orders", ORDERS_COLS, ORDERS_NULLS, keep)


def round_doubles(df: DataFrame, digits: int = 6, per_column: dict | None = None) -> DataFrame:
    """Round every double/float column (both sides of the oracle round alike);
    ``per_column`` overrides the digits for large-magnitude columns."""
    per = per_column or {}
    return df.select(*[
        F.round(F.col(f"`{f.name}`").cast("double"), per.get(f.name, digits)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])
