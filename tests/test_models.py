"""Learner registry and manager (the reference's model tests), learners
beating the majority class on a separable seeded fixture."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparkwright.operators import evaluate as EV
from sparkwright.operators import models as M


@pytest.fixture(scope="module")
def classification(spark):
    rng = np.random.default_rng(42)
    X = rng.normal(size=(200, 10))
    y = (X[:, 0] + 0.5 * X[:, 1] > 0).astype(float)
    pdf = pd.DataFrame({"id": np.arange(200), "x": list(X), "label": y})
    df = spark.createDataFrame(pdf).select("id", array_to_vector("x").alias("features"), "label")
    return df.where(F.col("id") < 150), df.where(F.col("id") >= 150)


def test_registry_lists_and_info():
    names = M.list_models()
    assert "Random Forest" in names and "Logistic Regression" in names
    assert M.models_by_category("Probabilistic") == ["Gaussian Naive Bayes", "Bernoulli Naive Bayes",
                                                     "Multinomial Naive Bayes"]
    info = M.model_info("Random Forest")
    assert set(info) == {"name", "category", "class", "supports_probability"}
    with pytest.raises(ValueError):
        M.get_learner("No Such Model")


def test_recommendations():
    assert M.recommendations("classification", 1000)
    assert M.recommendations("regression", 1000) == []
    assert M.recommendations("classification", 500)[0] == "Random Forest"


def test_untrained_model_raises(spark):
    mgr = M.ModelManager(spark)
    with pytest.raises(ValueError):
        mgr.get("Random Forest")


@pytest.mark.parametrize("name", ["Random Forest", "Decision Tree", "Logistic Regression",
                                  "Gaussian Naive Bayes", "Linear Discriminant Analysis",
                                  "Quadratic Discriminant Analysis", "Ridge Classifier",
                                  "K-Nearest Neighbors", "Support Vector Machine", "Bagging Classifier"])
def test_learner_beats_majority(spark, classification, name):
    train, test = classification
    mgr = M.ModelManager(spark)
    model = mgr.train(name, train)
    assert mgr.get(name) is model
    pred = M.predict(model, test)
    acc = EV.classification_metrics(pred).first()["accuracy"]
    p = test.agg(F.avg("label")).first()[0]
    assert acc > max(p, 1 - p) + 0.1
    hist = mgr.history_frame().first()
    assert hist["model_name"] == name and hist["training_samples"] == 150


def test_train_many_records_failures(spark, classification):
    train, _ = classification
    mgr = M.ModelManager(spark)
    res = {r["model"]: r["status"] for r in mgr.train_many(["Gaussian Naive Bayes", "Nope"], train).collect()}
    assert res == {"Gaussian Naive Bayes": "ok", "Nope": "failed"}


def test_isolation_forest_flags_outliers(spark):
    rng = np.random.default_rng(1)
    X = np.vstack([rng.normal(size=(300, 2)), [[8.0, 8.0], [-9.0, 7.0]]])
    df = spark.createDataFrame(pd.DataFrame({"x": list(X)})).select(array_to_vector("x").alias("features"))
    from sparkwright.operators.iforest import IsolationForestSpark
    out = IsolationForestSpark(n_trees=50, max_samples=128).fit(df).transform(df).toPandas()
    scores = out["anomaly_score"].to_numpy()
    assert scores[-2:].min() > np.quantile(scores[:-2], 0.99)
    assert set(out["prediction"].unique()) <= {-1.0, 1.0}


def test_auc_invariant_under_monotone_map(spark):
    rng = np.random.default_rng(5)
    s = rng.random(300)
    y = (rng.random(300) < s).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s}))
    a = EV.roc_auc(df).first()[0]
    b = EV.roc_auc(df.withColumn("score", F.exp(F.col("score") * 3))).first()[0]
    assert abs(a - b) < 1e-12
    # Mann-Whitney by brute force
    pos, neg = s[y == 1], s[y == 0]
    u = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(a - u) < 1e-12


def test_custom_flow_options(spark):
    """Per-column scalers, winsorize, missing 'drop' and rare 'drop' in the custom flow."""
    from sparkwright.plans import prep as PR
    rows = [(i, float(i % 50) if i % 9 else None, float(i % 13), "a" if i % 20 else "rare", "x" if i % 2 else "y")
            for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, v double, w double, c string, target string")
    specs = {"v": PR.ColumnSpec(missing="drop", scaling="robust"),
             "w": PR.ColumnSpec(scaling="winsorize"),
             "c": PR.ColumnSpec(rare_categories="drop", rare_threshold=10.0)}
    out = PR.prep_custom(df, "target", ["id"], specs, fit_on="all").frame.toPandas()
    kept = [r for r in rows if r[1] is not None and r[3] != "rare"]
    assert len(out) == len(kept)
    import numpy as np
    v = np.array([r[1] for r in rows if r[1] is not None])
    med = np.percentile(v, 50)
    iqr = np.percentile(v, 75) - np.percentile(v, 25)
    got = dict(zip(out["id"], out["v"]))
    for r in kept:
        assert abs(got[r[0]] - (r[1] - med) / iqr) < 1e-9
    w = np.array([r[2] for r in rows])
    lo, hi = np.percentile(w, 5), np.percentile(w, 95)
    assert out["w"].min() >= lo - 1e-9 and out["w"].max() <= hi + 1e-9


def test_quick_flow_median_option(spark):
    from sparkwright.plans import prep as PR
    rows = [(i, float(i) if i % 4 else None, "p" if i % 3 else "q") for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, x double, t string")
    p = PR.prep_quick(df, "t", ["id"], missing="median", scaling="none", fit_on="all")
    assert p.frame.where("x IS NULL").count() == 0
    assert any(s.op == "impute_median" for s in p.steps)


@pytest.mark.parametrize("name", ["Linear Discriminant Analysis", "Quadratic Discriminant Analysis"])
def test_discriminants_over_partitions_without_rows(spark, classification, name):
    train, test = classification
    dealt = train.select(train.id, train.features, train.label).repartition(60, (F.col("id") % 3).cast("int"))
    got, want = (M.predict(M.get_learner(name).build({}, {}).fit(df), test).select("id", "prediction").orderBy("id").collect()
                 for df in (dealt, train))
    assert got == want
