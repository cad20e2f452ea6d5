"""Table sources and sinks.

CSV and JSON are read with every column as text first; missing-value tokens
become null and each column is then typed by one distributed pass, the way a
header-row CSV upload is typed (integer, else float, else boolean, else text).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.functions.columns import normalize_missing, q

# Missing-value tokens of the CSV/JSON readers being matched (fixed values).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

SUPPORTED_FORMATS = ("csv", "json", "parquet")


def _null_tokens(df: DataFrame, tokens=NA_TOKENS) -> DataFrame:
    return df.select(*[
        F.when(~q(f.name).isin(tokens), q(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else q(f.name)
        for f in df.schema.fields
    ])


# Forms that a cast can read at all (the cast still decides).  A cast that fails raises an error inside, with its
# whole message, which costs some ten times what reading the line does; so no text of another form is cast.
_WHOLE = r"^[\x00-\x20]*[+-]?[0-9]+[\x00-\x20]*$"           # read as a float too
_WHOLE_DEL = r"^[\x00-\x20\x7F]*[+-]?[0-9]+[\x00-\x20\x7F]*$"  # with delete characters around it: as an integer only
_FLOAT = (r"^[\x00-\x20]*[+-]?([0-9]*+\.?[0-9]*+([eE][+-]?[0-9]+)?[dDfF]?|0[xX][0-9A-Fa-f]*+\.?[0-9A-Fa-f]*+[pP][+-]?[0-9]+[dDfF]?"
          r"|(?i:inf|infinity|nan))[\x00-\x20]*$")
_NO_LONG, _NO_DOUBLE, _NO_BOOL = 1, 2, 4


def _misfits(c: Column) -> Column:
    """Types that a value cannot have, as bits; null for a null."""
    own = F.trim(c)

    def fits(form, kind):
        return F.when(form, own.try_cast(kind)).isNotNull()

    return F.when(c.isNull(), None) \
        .when(fits(own.rlike(_WHOLE), "bigint"), _NO_BOOL) \
        .when(fits(own.contains("\x7f") & own.rlike(_WHOLE_DEL), "bigint"), _NO_DOUBLE + _NO_BOOL) \
        .when(fits(own.rlike(_FLOAT), "double"), _NO_LONG + _NO_BOOL) \
        .when(c.isin(TRUE_TOKENS + FALSE_TOKENS), _NO_LONG + _NO_DOUBLE) \
        .otherwise(_NO_LONG + _NO_DOUBLE + _NO_BOOL)


def infer_types(df: DataFrame) -> DataFrame:
    """Type every text column by one aggregate pass over the data."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    stats = df.agg(*[F.bit_or(_misfits(q(name))).alias(f"m{i}") for i, name in enumerate(text)]).first()
    cols = []
    for f in df.schema.fields:
        c = q(f.name)
        if f.name not in text:
            cols.append(c)
            continue
        misfits = stats[f"m{text.index(f.name)}"]
        if misfits is None:
            cols.append(c)  # all missing stays text (object) like the reader
        elif not misfits & _NO_LONG:
            cols.append(F.trim(c).try_cast("bigint").alias(f.name))
        elif not misfits & _NO_DOUBLE:
            cols.append(F.trim(c).try_cast("double").alias(f.name))
        elif not misfits & _NO_BOOL:
            cols.append(c.isin(TRUE_TOKENS).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def read_csv(spark: SparkSession, path: str, infer: bool = True, multiline: bool = False) -> DataFrame:
    """Header-row CSV.  ``multiline`` (quoted newlines) makes a file one task,
    so it is off unless asked for; plain CSV splits across tasks."""
    raw = (spark.read.option("header", True).option("inferSchema", False)
           .option("multiLine", multiline).option("escape", '"')
           .option("nullValue", None).option("emptyValue", "")
           .csv(path))
    raw = _null_tokens(raw)
    return infer_types(raw) if infer else raw


def read_json(spark: SparkSession, path: str, orient: str = "records") -> DataFrame:
    """JSON table: ``records`` (array of objects), ``lines`` (one object per
    line) or ``columns`` (one object mapping column -> {row label -> value})."""
    if orient == "lines":
        return normalize_missing(spark.read.json(path))
    if orient == "records":
        return normalize_missing(spark.read.option("multiLine", True).json(path))
    if orient != "columns":
        raise ValueError(f"unknown JSON orientation {orient!r}")
    # One object holds the whole table, so one task parses it; its cells are then dealt by row label.
    cells = F.from_json("value", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())))
    long = spark.read.text(path, wholetext=True).select(F.explode(cells).alias("__column", "__cells"))
    names = [r["__column"] for r in long.select("__column").distinct().collect()]  # the output's columns
    order = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    keys = spark.read.text(path, wholetext=True).select(F.explode(F.map_keys(order)).alias("k")).collect()
    names = sorted(names, key=[r["k"] for r in keys].index)
    rows = long.select("__column", F.explode("__cells").alias("__row", "__value"))
    out = rows.groupBy("__row").pivot("__column", names).agg(F.first("__value"))
    out = out.orderBy(F.col("__row").try_cast("bigint"), "__row").drop("__row")
    return infer_types(_null_tokens(out))


def load_table(spark: SparkSession, path: str, fmt: str | None = None, **opts) -> DataFrame:
    """Dispatch on the extension (or ``fmt``); NaN becomes null once here."""
    if fmt is None:
        ext = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
        fmt = ext or "parquet"
    if fmt not in SUPPORTED_FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; use one of {SUPPORTED_FORMATS}")
    if fmt == "csv":
        return read_csv(spark, path, **opts)
    if fmt == "json":
        return read_json(spark, path, **opts)
    return normalize_missing(spark.read.parquet(path))


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """CSV sink; ``single_file`` only for small report tables (e.g. a comparison)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def cache_table(df: DataFrame, name: str) -> DataFrame:
    """Keep a table between steps (session copy) and expose it to SQL."""
    df = df.persist()
    df.createOrReplaceTempView(name)
    return df
