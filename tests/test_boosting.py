"""Boosted trees: splits against plain loops, both ways of growing, learners beating the majority."""

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparkwright.operators import boosting as B
from sparkwright.operators import models as M


def frame(spark, x, y, parts=3):
    pdf = pd.DataFrame({"id": np.arange(len(y)), "x": list(x), "label": y.astype(float)})
    return spark.createDataFrame(pdf).repartition(parts).select("id", array_to_vector("x").alias("features"), "label")


@pytest.fixture(scope="module")
def classes():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 6))
    x[:, 5] = 1.0                                       # a constant feature
    return x, np.digitize(x[:, 0] + 0.3 * x[:, 1] ** 2, [-0.5, 0.1, 0.7])


def test_first_split_is_the_best_of_all(classes):
    x, y = classes
    edges = [sorted(set(np.quantile(x[:, j], np.arange(1, 32) / 32))) for j in range(6)]
    bins = B.to_bins(x, edges)
    g, h = 0.25 - (y == 2), np.full(len(y), 0.1875)
    rule = B.Rule(l2=1.0, min_rows=5)
    hist = B.histogram(bins, np.zeros(len(y), dtype=int), np.column_stack([g, h, np.ones(len(y))]), 1)
    (_, f, c, gain, left, _), = B.decide(hist, rule, 0, np.ones(6, dtype=bool))
    best = max((sum(s.sum() ** 2 / (w.sum() + 1.0) for s, w in ((g[m], h[m]), (g[~m], h[~m]))) - g.sum() ** 2 / (h.sum() + 1.0), -j, -b)
               for j in range(6) for b in range(31) for m in [bins[:, j] <= b] if 5 <= m.sum() <= len(y) - 5)
    assert (gain, f, c) == (pytest.approx(best[0]), -best[1], -best[2])
    assert left[2] == (bins[:, f] <= c).sum() and left[0] == pytest.approx(g[bins[:, f] <= c].sum())


@pytest.mark.parametrize("rule", [M.PLAIN, M.NEWTON, M.BEST_LEAVES, M.OBLIVIOUS], ids=["plain", "newton", "leaves", "oblivious"])
def test_a_bounded_table_grows_the_same_trees(spark, classes, rule):
    x, y = classes
    df = frame(spark, x, y)
    rule = replace(rule, depth=3, leaves=6)
    local, levels = (B.TreeBoosting(2, rule, subsample=0.7, colsample=0.8, local_rows=n).fit(df) for n in (10_000, 0))
    assert local.kind == "softmax" and len(local.trees[0]) == 4
    for a, b in zip(local.trees, levels.trees):
        for s, t in zip(a, b):
            assert (s["feature"] == t["feature"]).all() and (s["cut"] == t["cut"]).all() and np.allclose(s["value"], t["value"])
            if rule.growth == "leaves":
                assert (s["feature"] >= 0).sum() <= 5
            if rule.growth == "oblivious":
                for level in range(3):
                    own = s["feature"][2 ** level - 1:2 ** (level + 1) - 1]
                    assert len(set(own[own >= 0])) <= 1


def test_scores_written_between_rounds_change_nothing(spark, classes, monkeypatch):
    x, y = classes
    df = frame(spark, x, (y > 1).astype(int))
    want = B.TreeBoosting(5, M.NEWTON).fit(df)
    monkeypatch.setattr(B, "KEEP_ROUNDS", 2)
    got = B.TreeBoosting(5, M.NEWTON).fit(df)
    assert got.kind == "logistic" and got._state() == want._state()
    p = M.predict(got, df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")),
                               F.max(F.abs(F.col("probability")[0] + F.col("probability")[1] - 1))).first()
    assert p[0] > 0.95 and p[1] < 1e-9


@pytest.mark.parametrize("name", ["Gradient Boosting", "XGBoost", "LightGBM", "CatBoost", "AdaBoost"])
def test_beats_the_majority_of_four_classes(spark, classes, name):
    x, y = classes
    df = frame(spark, x, y)
    model = M.ModelManager(spark).train(name, df.where("id < 700"), {"n_estimators": 12})
    out = M.predict(model, df.where("id >= 700")).select("label", "prediction", "probability").toPandas()
    share = np.bincount(y[700:]).max() / 200
    assert (out["label"] == out["prediction"]).mean() > share + 0.15
    assert np.allclose([sum(p) for p in out["probability"]], 1.0)
    if name != "AdaBoost":
        best = M.feature_importances(model, [f"f{j}" for j in range(6)], 2).collect()
        assert best[0]["feature"] == "f0"


def test_ada_boost_follows_its_definition(spark, classes):
    x, y = classes
    df = frame(spark, x, y)
    model = B.AdaBoostSAMME(4).fit(df)
    bins = B.to_bins(x, model.edges)
    w = np.full(len(y), 1.0 / len(y))
    for s in model.stumps:
        miss = np.where(bins[:, s["feature"]] > s["cut"], s["right"], s["left"]) != y
        error = w[miss].sum() / w.sum()
        assert s["weight"] == pytest.approx(math.log((1 - error) / error) + math.log(3), rel=1e-9)
        w = w * np.exp(s["weight"] * miss)
        w /= w.sum()


def test_boosted_regression(spark, classes):
    x, _ = classes
    y = 3.0 * x[:, 0] + np.sin(3 * x[:, 1])
    df = frame(spark, x, y)
    for name in ("Gradient Boosting Regressor", "XGBoost Regressor"):
        model = M.ModelManager(spark).train(name, df.where("id < 700"), {"n_estimators": 40})
        out = M.predict(model, df.where("id >= 700")).select("label", "prediction").toPandas()
        assert 1 - ((out["label"] - out["prediction"]) ** 2).sum() / ((out["label"] - out["label"].mean()) ** 2).sum() > 0.85


def test_rows_of_the_same_bins_are_one_row(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, size=(600, 1)).astype(float)
    y = x[:, 0] ** 2 + rng.normal(size=600)
    want = B.TreeBoosting(5, replace(M.NEWTON, depth=3), regression=True, subsample=0.999999999, local_rows=0).fit(frame(spark, x, y))
    monkeypatch.setattr(B, "_grow_by_level", None)               # twelve rows differ, so a round is one job
    got = B.TreeBoosting(5, replace(M.NEWTON, depth=3), regression=True, local_rows=100).fit(frame(spark, x, y))
    for (a,), (b,) in zip(got.trees, want.trees):
        assert (a["feature"] == b["feature"]).all() and (a["cut"] == b["cut"]).all() and np.allclose(a["value"], b["value"])


def test_histograms_are_sent_by_core_not_by_input_part(spark, classes, monkeypatch):
    x, y = classes
    seen = []
    grow = B._grow_by_level
    monkeypatch.setattr(B, "_grow_by_level", lambda state, *rest: seen.append(state.rdd.getNumPartitions()) or grow(state, *rest))
    B.TreeBoosting(1, replace(M.NEWTON, depth=2), local_rows=0).fit(frame(spark, x, y, parts=40))
    assert seen == [spark.sparkContext.defaultParallelism]
