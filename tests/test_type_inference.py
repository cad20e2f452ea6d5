"""Types of text columns: the pre-tests of their form change no type that the casts alone would give."""

import random

from pyspark.sql import functions as F

from sparkwright.sources import io as IO

ODD = ["12", " 12 ", "+5", "--7", "12\x7f", "\t12\n", "9223372036854775807", "9223372036854775808", "1.5", "1.", ".", "", " ",
       "1e5", "1e", "1d", "2L", "0x1p3", "0x.8P-2f", "0x1", "-Inf", "InFiNiTy", "+NaN", "nan", "\x0bnan", "1994-01-01",
       "1994-01-01T00:00:00.000Z", "A", "True", "true", " true", "tRue", "1,5", "\u0661", "\u00a01", "1\u0085", "1.5\x7f", "+.", "d",
       "0xp1", "\x007\x00", "12 \x7f "]


def test_misfits_are_those_of_the_casts(spark):
    rng = random.Random(3)
    values = ODD + ["".join(rng.choice("0123456789+-.eEdDfFxXpPinatyINF \t\x7f\x00\n\x85A") for _ in range(rng.randint(1, 6)))
                    for _ in range(1500)] + [None]
    v, own = F.col("v"), F.trim("v")
    plain = F.when(v.isNotNull(), F.when(own.try_cast("bigint").isNull(), IO._NO_LONG).otherwise(0)
                   + F.when(own.try_cast("double").isNull(), IO._NO_DOUBLE).otherwise(0)
                   + F.when(v.isin(IO.TRUE_TOKENS + IO.FALSE_TOKENS), 0).otherwise(IO._NO_BOOL))
    df = spark.createDataFrame([(x,) for x in values], "v string")
    rows = df.select("v", IO._misfits(v).alias("got"), plain.alias("want")).collect()
    assert [r for r in rows if r["got"] != r["want"]] == []


def test_types_of_columns(spark):
    rows = [("1", "1", "1.5", "True", "x", None, "1\x7f", "True"), (None, "2.5", "nan", "false", "1", None, "1.5", "1")]
    typed = IO.infer_types(spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string, h string"))
    assert [t for _, t in typed.dtypes] == ["bigint", "double", "double", "boolean", "string", "string", "string", "string"]
    assert typed.select("a", "b", "d").collect() == [(1, 1.0, True), (None, 2.5, False)]


def test_no_cast_of_a_form_it_cannot_read(spark):
    """Each cast stands behind a test of the form, so what a text column costs is no raised errors."""
    plan = spark.createDataFrame([("x",)], "v string").agg(F.bit_or(IO._misfits(F.col("v"))))._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_cast") == plan.count("THEN try_cast") == 3
