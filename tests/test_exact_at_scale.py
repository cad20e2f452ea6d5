"""Exact quantiles, forests and moments beyond the small tables."""

import json

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparkwright.functions import columns as C
from sparkwright.operators.iforest import IsolationForestSpark
from sparkwright.operators.models import LinearDiscriminant, QuadraticDiscriminant, _class_moments
from sparkwright.operators.profile import describe
from sparkwright.sources.io import read_json

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def frames(spark):
    rng = np.random.default_rng(4)
    n = 30_000
    return {
        "skewed": spark.createDataFrame([(float(x),) for x in rng.lognormal(0, 3, n)], "x double"),
        "ties": spark.createDataFrame([(float(x) if x else None,) for x in rng.integers(0, 4, n)], "x double"),
        "two": spark.createDataFrame([(1.0,), (2.0,)], "x double"),
        "none": spark.createDataFrame([(None,)], "x double"),
    }


@pytest.mark.parametrize("name", ["skewed", "ties", "two", "none"])
def test_rank_selection_equals_percentile(spark, monkeypatch, name):
    df = frames(spark)[name]
    small = df.agg(C.quantiles(df, F.col("x"), PROBS).alias("q")).first()["q"]
    monkeypatch.setattr(C, "ONE_TASK_BYTES", -1)
    large = df.agg(C.quantiles(df, F.col("x"), PROBS).alias("q")).first()["q"]
    if small is None or small[0] is None:
        assert large == [None] * len(PROBS)
    else:
        assert np.allclose(small, large, rtol=1e-12)


def test_ranks_between_ties_leave_the_values_in_the_tasks(spark, monkeypatch):
    """A 0/1 column whose median lies on the boundary, next to an untied one: only asked values are collected."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic
    df = spark.range(20_000).selectExpr("cast(id < 10000 AS double) AS bit", "cast(id AS double) AS own", "cast(NULL AS double) AS none") \
        .repartition(6)
    seen = []
    collect = Classic.collect
    monkeypatch.setattr(Classic, "collect", lambda self: seen.append(rows := collect(self)) or rows)
    got = C.ranked(df, [(F.col("bit"), [0.25, 0.5, 0.75]), (F.col("own"), [0.5, 0.999]), (F.col("none"), [0.5])])
    assert got == [[0.0, 0.5, 1.0], [9999.5, pytest.approx(19979.001)], [None]]
    assert sum(map(len, seen)) <= 2 * 5
    assert "collect_list" not in open(C.__file__).read()


def test_distinct_counts_of_every_type(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "a", True, b"x", [1], None), (1, -0.0, "a", None, b"y", [1], None), (None, 0.0, "", False, None, [2], None),
         (2, float("nan"), "A", True, b"x", None, None), (3, float("nan"), None, True, b"", [], None)],
        "i int, d double, s string, b boolean, y binary, a array<int>, n date")
    df = df.withColumns({"m": F.col("i").cast("decimal(30,2)"), "t": F.lit("2020-01-01").cast("timestamp_ntz")})
    got = {r["column_name"]: r["n_unique"] for r in C.distinct_counts(df, df.columns).collect()}
    want = df.select(*[F.count_distinct(c).alias(c) for c in df.columns]).first().asDict()
    assert got == want
    plan = C.distinct_counts(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    assert C.distinct_counts(df.limit(0), ["i", "s"]).collect() == [("i", 0), ("s", 0)]


def test_describe_is_the_same_on_either_path(spark, monkeypatch):
    df = frames(spark)["skewed"]
    small = describe(df).collect()
    monkeypatch.setattr(C, "ONE_TASK_BYTES", -1)
    assert describe(df).collect() == small


def test_isolation_forest_of_many_rows_with_a_hot_point(spark):
    df = spark.range(110_000).select(array_to_vector(F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(1.0))).otherwise(
        F.array(F.rand(1), F.rand(2)))).alias("features"))
    model = IsolationForestSpark(n_trees=20)._fit(df)
    assert len(model.trees) == 20 and all(t["size"][0] == 256 for t in model.trees)
    far = spark.createDataFrame([([0.5, 0.5],), ([-9.0, 9.0],)], "a array<double>").select(array_to_vector("a").alias("features"))
    near, out = (r["anomaly_score"] for r in model.transform(far).collect())
    assert out > near


@pytest.mark.parametrize("learner", [LinearDiscriminant, QuadraticDiscriminant])
def test_discriminants_far_from_zero(spark, learner):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 2000)
    x = rng.normal(size=(2000, 3)) + 1.2 * y[:, None]

    def accuracy(shift):
        df = spark.createDataFrame([(float(a), (b + shift).tolist()) for a, b in zip(y, x)], "label double, a array<double>") \
            .select("label", array_to_vector("a").alias("features"))
        return learner()._fit(df).transform(df).where("prediction = label").count() / 2000
    near = accuracy(0.0)
    assert near > 0.85 and abs(accuracy(1e9) - near) < 0.01


def test_moments_match_numpy(spark):
    rng = np.random.default_rng(3)
    y, x = rng.integers(0, 3, 500), rng.normal(size=(500, 4)) + 1e8
    df = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(y, x)], "label double, a array<double>") \
        .repartition(7).select("label", array_to_vector("a").alias("features"))
    for c, m in _class_moments(df, 4).items():
        own = x[y == c]
        assert m["n"] == len(own) and np.allclose(m["mean"], own.mean(axis=0), rtol=1e-14)
        assert np.allclose(m["scatter"], (own - own.mean(axis=0)).T @ (own - own.mean(axis=0)), rtol=1e-6, atol=1e-5)


def test_column_json_keeps_every_row(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"b": {"0": 1}, "a": {"0": "x", "1": "y", "10": None}}))
    out = read_json(spark, str(path), "columns")
    assert out.columns == ["b", "a"]
    assert [tuple(r) for r in out.collect()] == [(1, "x"), (None, "y"), (None, None)]


def test_empty_and_one_class_tables_divide_safely(spark):
    from sparkwright.operators import evaluate as E
    from sparkwright.operators import profile as P
    none = spark.createDataFrame([], "x double, s string")
    for f in (P.column_info, P.missing_summary):
        f(none).collect()
    one = spark.createDataFrame([(1, 0.2, [0.8, 0.2]), (1, 0.9, [0.1, 0.9])], "label int, score double, probability array<double>")
    assert E.roc_auc(one).first()["roc_auc"] is None
    assert E.roc_auc_ovr(one).first()["roc_auc"] is None
    assert {r["fpr"] for r in E.roc_curve(one).collect()} == {None}
    E.classification_metrics(one.limit(0).withColumn("prediction", F.lit(1))).collect()


def test_correlations_with_gaps_far_from_zero(spark):
    import pandas as pd
    from sparkwright.operators.profile import correlation_pairs
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 4)) @ rng.normal(size=(4, 4)) + 1e8
    x[rng.random(x.shape) < 0.2] = np.nan
    pdf = pd.DataFrame(x, columns=list("abcd"))
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) + (7.0,) for r in x],
                               "a double, b double, c double, d double, flat double").repartition(5)
    want = pdf.corr()
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in correlation_pairs(df).collect()}
    assert len(got) == 10 and all(v is None for (a, _), v in got.items() if a == "flat")
    for (a, b), v in got.items():
        if a != "flat":
            assert v == pytest.approx(want.loc[a, b], abs=1e-6)
