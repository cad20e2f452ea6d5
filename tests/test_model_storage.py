"""Every learner is saved, loaded by what the folder says, and predicts the same."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from sparkwright.operators import models as M

SMALL = {"Random Forest": {"n_estimators": 5}, "AdaBoost": {"n_estimators": 4}, "Multi-layer Perceptron": {"max_iter": 15},
         "Isolation Forest": {"n_estimators": 7, "max_samples": 32}, "Bagging Classifier": {"n_estimators": 3},
         "Random Forest Regressor": {"n_estimators": 5}, "K-Nearest Neighbors": {"n_neighbors": 3},
         "SGD Classifier": {"max_iter": 10}, "Support Vector Machine": {"max_iter": 10}}
SMALL |= {n: {"n_estimators": 3, "max_depth": 3} for n in
          ("Gradient Boosting", "XGBoost", "LightGBM", "CatBoost", "Gradient Boosting Regressor", "XGBoost Regressor")}


@pytest.fixture(scope="module")
def three(spark):
    rng = np.random.default_rng(1)
    x = rng.random(size=(150, 4))
    y = np.digitize(x[:, 0] + 0.2 * x[:, 1], [0.4, 0.8]).astype(float)
    pdf = pd.DataFrame({"id": np.arange(150), "big": 2 ** 60 + np.arange(150), "x": list(x), "label": y})
    return spark.createDataFrame(pdf).select("id", F.expr("CASE WHEN id % 2 = 0 THEN big END").alias("big"),
                                             array_to_vector("x").alias("features"), "label").coalesce(2).persist()


def answers(model, df):
    out = M.predict(model, df)
    own = [c for c in ("prediction", "probability", "anomaly_score") if c in out.columns]
    raw = [vector_to_array("rawPrediction").alias("raw")] if "rawPrediction" in out.columns else []
    rows = out.select("id", "big", *own, *raw).orderBy("id").collect()
    assert [r["big"] for r in rows] == [2 ** 60 + i if i % 2 == 0 else None for i in range(150)]
    return rows


@pytest.mark.parametrize("name", M.list_models() + M.list_regressors())
def test_saved_and_loaded(spark, three, tmp_path, name):
    mgr = M.ModelManager(spark, folder=f"file://{tmp_path}/models")
    mgr.train(name, three.drop("big"), SMALL.get(name))
    path = mgr.save(name)
    assert mgr.saved() == [path.rsplit("/", 1)[1]] and path.startswith(mgr.folder + "/" + name.replace(" ", "_"))
    other = M.ModelManager(spark)
    model = other.load(path, "again")
    assert other.get("again") is model and type(model) is type(mgr.get(name))
    assert answers(model, three) == answers(mgr.get(name), three)
    mgr.save(name, path)                      # a second writing replaces the first


def test_what_is_not_there(spark, tmp_path):
    mgr = M.ModelManager(spark, folder=str(tmp_path / "none"))
    assert mgr.saved() == []
    with pytest.raises(ValueError):
        mgr.save("Random Forest")


def test_models_stand_in_pipelines(spark, three, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from sparkwright.operators.boosting import AdaBoostSAMME
    model = Pipeline(stages=[M.LinearDiscriminant()]).fit(three)
    both = PipelineModel(stages=[model.stages[0]])
    both.write().overwrite().save(str(tmp_path / "p"))
    again = M.ModelManager(spark).load(str(tmp_path / "p"))
    assert answers(again, three) == answers(model, three)
    assert AdaBoostSAMME(2).fit(three).k == 3


def test_regressors_are_scored_by_r2(spark, three):
    df = three.select("id", "features", (vector_to_array("features")[0] * 3 + vector_to_array("features")[1]).alias("label"))
    for name in M.list_regressors():
        scores = M.cross_validate(name, df, ["id"], k=2, params=SMALL.get(name))
        r = M.cv_summary(scores).first()
        assert r["n_folds"] == 2 and len(r["cv_scores"]) == 2 and r["cv_mean"] > 0.3
        assert name != "Linear Regression" or r["cv_mean"] > 0.999
