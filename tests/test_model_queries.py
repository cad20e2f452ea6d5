"""The registered fits use the learners' own defaults and every class of the embeddings."""

import pytest
from conftest import SF_SMALL

from sparkwright.operators import features as FE
from sparkwright.operators import models as M
from sparkwright.plans.catalog import all_queries


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["Gradient Boosting", "XGBoost", "LightGBM", "CatBoost", "AdaBoost",
                                  "Multi-layer Perceptron"])
def test_fits_use_defaults_and_all_classes(spark, monkeypatch, name):
    def train(self, name, df, params=None):
        raise Seen(name, params, df.select("label").distinct().count())
    monkeypatch.setattr(M.ModelManager, "train", train)
    with pytest.raises(Seen) as seen:
        all_queries()["fit_" + name.lower().replace("-", "_").replace(" ", "_")](spark, SF_SMALL)
    classes = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("label").distinct().count()
    assert classes > 2 and seen.value.args == (name, None, classes)


def test_grid_search_runs_as_long_as_the_learner(spark, monkeypatch):
    def search(estimator, *args, **kwargs):
        raise Seen(estimator.getMaxIter())
    monkeypatch.setattr(FE, "grid_search", search)
    with pytest.raises(Seen) as seen:
        all_queries()["grid_search"](spark, SF_SMALL)
    assert seen.value.args == (M.get_learner("Logistic Regression").build({}, {"n": 1}).getMaxIter(),)
