"""Registered source/sink queries (A1-A3): a table written as CSV / JSON lines
into the shared checkpoint folder and read back through the typed readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkwright.plans.q_eval import _compare_sql, q_compare_models
from sparkwright.plans.registry import register
from sparkwright.plans.tables import lineitem_nulls, lineitem_nulls_sql, round_doubles
from sparkwright.session import checkpoint_dir
from sparkwright.sources import io as IO

COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
DBL = {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}


def _scratch(spark, tag: str) -> str:
    # the shared folder named by spark.checkpoint.dir, never a machine-local one
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def _sel():
    out = []
    for c in COLS:
        if c in DBL:
            out.append(f"round({c}, 6) AS {c}")
        elif c == "l_linenumber":
            out.append(f"CAST({c} AS BIGINT) AS {c}")
        elif c == "l_shipdate":
            out.append(f"CAST({c} AS VARCHAR) AS {c}")
        else:
            out.append(c)
    return ", ".join(out)


def _dates_as_text(df):
    """Both engines write a time in one form; readers differ in the type that they infer for it."""
    return df.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz").cast("string"))


@register("scan_csv", f"SELECT {_sel()} FROM {lineitem_nulls_sql(COLS)}")
def q_scan_csv(spark, d):
    path = _scratch(spark, "scan_csv")
    IO.write_csv(lineitem_nulls(spark, d, COLS), path)
    return round_doubles(_dates_as_text(IO.load_table(spark, path, fmt="csv")))


@register("scan_json", f"SELECT {_sel()} FROM {lineitem_nulls_sql(COLS)}")
def q_scan_json(spark, d):
    path = _scratch(spark, "scan_json")
    lineitem_nulls(spark, d, COLS).write.mode("overwrite").json(path)
    df = IO.load_table(spark, path, fmt="json", orient="lines").select(*COLS)
    return round_doubles(_dates_as_text(df))


@register("scan_parquet", f"SELECT {', '.join(c if c not in DBL else f'round({c}, 6) AS {c}' for c in COLS)} "
          f"FROM lineitem")
def q_scan_parquet(spark, d):
    return round_doubles(IO.load_table(spark, f"{d}/lineitem.parquet").select(*COLS))


@register("sink_comparison_csv", _compare_sql())
def q_sink_comparison_csv(spark, d):
    """The model comparison table through the CSV sink and back, all columns and values."""
    path = _scratch(spark, "sink_csv")
    table_ = q_compare_models(spark, d)
    IO.write_csv(table_, path, single_file=True)
    back = IO.read_csv(spark, path, infer=False)
    return back.select(*[F.col(f.name).cast(f.dataType) for f in table_.schema.fields])
