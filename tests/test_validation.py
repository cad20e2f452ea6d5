"""Validator / profile behaviour on the small inline fixtures (FIXTURES.md §1)."""

import random

from pyspark.sql import functions as F

from sparkwright.operators import profile as P
from sparkwright.operators import quality as Q


def _report(df):
    return {(r["kind"], r["item"]): r["value"] for r in Q.validate_report(df).collect()}


def test_empty_frame_is_invalid(spark):
    df = spark.createDataFrame([], "a bigint")
    rep = _report(df)
    assert rep[("issue", "empty")] == 0.0
    assert rep[("statistic", "is_valid")] == 0.0
    assert P.is_empty(df)
    no_cols = spark.range(3).select()
    assert P.is_empty(no_cols)


def test_valid_frame(spark):
    df = spark.createDataFrame(
        [(1, "A", 0), (2, "B", 1), (3, "A", 0), (4, "C", 1), (5, "B", 0)],
        "numeric_col bigint, categorical_col string, target bigint")
    rep = _report(df)
    assert rep[("statistic", "is_valid")] == 1.0
    assert (rep[("statistic", "n_rows")], rep[("statistic", "n_cols")]) == (5.0, 3.0)
    assert rep[("statistic", "total_missing")] == 0.0
    assert not any(k[0] == "warning" for k in rep)


def test_missing_values(spark):
    df = spark.createDataFrame(
        [(1.0, "A"), (2.0, None), (None, "C"), (4.0, None), (5.0, "E")], "col1 double, col2 string")
    s = P.missing_summary(df).first()
    assert s["total_missing"] == 3
    cols = {r["column_name"]: r["missing_count"] for r in P.profile_missing(df).collect()}
    assert cols == {"col1": 1, "col2": 2}


def test_nan_counts_as_missing(spark):
    from sparkwright.functions.columns import normalize_missing
    df = normalize_missing(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert P.missing_summary(df).first()["total_missing"] == 1


def test_target_suggestions(spark):
    rng = random.Random(7)
    rows = [(rng.random(), rng.random(), rng.randint(0, 1), rng.choice("ABC"), rng.random() * 100)
            for _ in range(100)]
    df = spark.createDataFrame(rows, "feature1 double, feature2 double, binary_target bigint, "
                                     "multi_class string, continuous double")
    got = {r["column_name"] for r in Q.suggest_targets(df).collect()}
    assert "binary_target" in got and "multi_class" in got
    assert "continuous" not in got


def test_duplicates_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, 1), (1, 2)], "a int, b int")
    r = P.duplicate_rows(df).first()
    assert (r["n_rows"], r["n_duplicates"]) == (4, 1)


def test_column_name_checks(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["Unnamed: 0", "ok_name", "bad-name", "_c3"])
    got = {(r["issue"], r["column_name"]) for r in Q.column_name_issues(df).collect()}
    assert got == {("unnamed", "Unnamed: 0"), ("unnamed", "_c3"), ("special_characters", "bad-name")}


def test_names_and_types_count_their_values(spark):
    df = spark.createDataFrame([(1, None, "x", 1.0), (2, None, None, 2.0)], "`_c0` int, `a%` string, b string, c double")
    issues = {tuple(r) for r in Q.column_name_issues(df).collect()}
    assert issues == {("unnamed", "_c0", 2), ("special_characters", "a%", 0)}
    twice = df.select("b", "c", "b")
    assert [tuple(r) for r in Q.column_name_issues(twice).collect()] == [("duplicate", "b", 1)]
    assert Q.column_name_issues(df.select("b")).count() == 0
    types = {tuple(r) for r in P.profile_dtypes(df).collect()}
    assert types == {("int32", 1, 2), ("object", 2, 1), ("float64", 1, 2)}
    assert {r["n_values"] for r in P.profile_dtypes(df.limit(0)).collect()} == {0}
    assert P.profile_dtypes(df.select()).count() == 0


def test_skewness_bias_corrected(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    v = P.skewness(df).first()["skewness"]
    assert abs(v - 1.4693) < 1e-3


def test_mode_smallest_on_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "x string")
    assert P.mode_frame(df, "x").first()["mode"] == "a"


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "x double")
    h = {r["bin"]: r["count"] for r in P.histogram(df, "x", 30).collect()}
    assert sum(h.values()) == 4 and h[15] == 4


def test_task_type_rules(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("few"), F.col("id").cast("double").alias("many"))
    t = {r["column_name"]: r for r in Q.task_type(df, ["few", "many"]).collect()}
    assert t["few"]["is_classification"] and not t["many"]["is_classification"]


def test_metric_filter_drops_na_strings(spark):
    # A comparison table holding 'N/A' for metrics a model does not have
    from sparkwright.operators import evaluate as EV
    comp = spark.createDataFrame(
        [("a", "0.9", "N/A"), ("b", "0.7", "0.65"), ("c", "x1", "0.5")],
        "model string, accuracy string, roc_auc string")
    got = sorted(tuple(r) for r in EV.comparison_long(comp, ["accuracy", "roc_auc", "r2_score"]).collect())
    assert got == [("a", "accuracy", 0.9), ("b", "accuracy", 0.7), ("b", "roc_auc", 0.65), ("c", "roc_auc", 0.5)]


def test_top_k_orders_nulls_last_and_breaks_ties(spark):
    # sort_values(...).head(n) / tail(n) over a scored table
    from sparkwright.operators import evaluate as EV
    df = spark.createDataFrame(
        [("a", 0.5), ("b", None), ("c", 0.9), ("d", 0.5), ("e", 0.1)], "feature string, importance double")
    top = [tuple(r) for r in EV.top_k(df, "importance", 3, tie_cols=["feature"]).collect()]
    assert top == [("c", 0.9), ("a", 0.5), ("d", 0.5)]
    low = [tuple(r) for r in EV.top_k(df, "importance", 2, ascending=True, tie_cols=["feature"]).collect()]
    assert low == [("e", 0.1), ("a", 0.5)]
