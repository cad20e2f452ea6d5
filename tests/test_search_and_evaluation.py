"""One evaluation call, parameter search, scores far from zero."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparkwright.operators import evaluate as EV
from sparkwright.operators import features as FE
from sparkwright.operators import models as M


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3))
    y = np.digitize(x[:, 0] + 0.3 * rng.normal(size=240), [-0.4, 0.6]).astype(float)
    pdf = pd.DataFrame({"id": np.arange(240), "x": list(x), "label": y})
    return spark.createDataFrame(pdf).select("id", array_to_vector("x").alias("features"), "label").coalesce(2).persist()


def test_whole_evaluation_of_a_model(spark, frame):
    train, test = frame.where("id < 160"), frame.where("id >= 160")
    model = M.ModelManager(spark).train("Random Forest", train, {"n_estimators": 8})
    out = M.evaluate_model("Random Forest", model, test, ["id"], {"n_estimators": 4}, ["a", "b", "c"])
    pred = M.predict(model, test)
    one = out.metrics.first()
    assert one["accuracy"] == EV.classification_metrics(pred).first()["accuracy"]
    assert one["roc_auc"] == pytest.approx(EV.roc_auc_ovr(pred).first()["roc_auc"])
    assert one["log_loss"] == pytest.approx(EV.log_loss(pred).first()["log_loss"])
    assert out.confusion.agg(F.sum("count")).first()[0] == 80 and out.cv.count() == 5
    assert [r["feature"] for r in out.importances.limit(1).collect()] == ["a"]
    curves = out.roc.toPandas()
    for c, g in curves.groupby("class"):
        own = EV.roc_curve(pred.withColumn("s", F.col("probability")[int(c)]), score="s", positive=int(c)).toPandas()
        assert sorted(zip(g["fpr"], g["tpr"])) == sorted(zip(own["fpr"], own["tpr"])) and len(curves["class"].unique()) == 3
    sections = {r["section"] for r in out.long().select("section").distinct().collect()}
    assert sections == {"metric", "confusion", "report", "roc_fpr", "roc_tpr", "cv", "importance"}


def test_two_scans_of_the_predictions(spark, frame):
    """Predictions are read twice whatever is asked of the evaluation afterwards."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    pred = frame.select("label", (F.col("id") % 3).cast("double").alias("prediction"),
                        F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5)).alias("probability"))
    out = EV.evaluate_classification(pred.mapInPandas(count, pred.schema))
    out.long().collect()
    out.roc.collect()
    assert seen.value == 2 * 240


def test_two_classes_and_no_probabilities(spark):
    df = spark.createDataFrame([(0, 0, [0.9, 0.1]), (1, 1, [0.2, 0.8]), (1, 0, [0.6, 0.4]), (0, 1, [0.5, 0.5])],
                               "label int, prediction int, probability array<double>")
    assert EV.evaluate_classification(df).metrics.first()["roc_auc"] == pytest.approx(0.75)
    none = EV.evaluate_classification(df.drop("probability"))
    assert none.metrics.first()["roc_auc"] is None and none.roc is None and none.metrics.first()["accuracy"] == 0.5
    assert EV.evaluate_classification(df.limit(0)).metrics.first()["accuracy"] is None


def test_random_search_finds_the_grids_best(spark, frame):
    space = {"max_depth": [1, 2, 4], "min_samples_leaf": [1, 60]}
    model, best, scores = FE.random_search("Decision Tree", space, frame, ["id"], n_iter=10, folds=3, keep=0.5)
    full = FE.random_search("Decision Tree", space, frame, ["id"], n_iter=10, folds=3, keep=1.0)
    rows = scores.orderBy("candidate").collect()
    assert best == full[1] and len(rows) == 6 and [r["folds"] for r in full[2].collect()] == [3] * 6
    assert sorted(r["folds"] for r in rows) == [1, 1, 1, 2, 3, 3] and M.predict(model, frame).count() == 240


def test_draws_are_seeded_and_within_bounds():
    space = {"a": (2, 9), "b": ("log", 1e-4, 1.0), "c": ["x", "y"], "d": (0.5, 0.75)}
    drawn = FE.candidates(space, 20, seed=1)
    assert drawn == FE.candidates(space, 20, seed=1) != FE.candidates(space, 20, seed=2) and len(drawn) == 20
    for d in drawn:
        assert 2 <= d["a"] <= 9 and 1e-4 <= d["b"] <= 1 and d["c"] in "xy" and 0.5 <= d["d"] <= 0.75


def test_f_scores_far_from_zero(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 600)
    x = rng.normal(size=(600, 2)) + y[:, None] * [0.5, 0.0]

    def scores(shift):
        df = spark.createDataFrame([(int(c), *(v + shift).tolist()) for c, v in zip(y, x)], "y int, a double, b double")
        return {r["feature"]: r["f_score"] for r in FE.anova_f_scores(df, ["a", "b"], "y").collect()}
    near, far = scores(0.0), scores(1e9)
    overall = x.mean(axis=0)
    for j, c in enumerate("ab"):
        groups = [x[y == k, j] for k in range(3)]
        want = (sum(len(g) * (g.mean() - overall[j]) ** 2 for g in groups) / 2) / (sum(((g - g.mean()) ** 2).sum() for g in groups) / 597)
        assert near[c] == pytest.approx(want) and far[c] == pytest.approx(want, rel=1e-4)
