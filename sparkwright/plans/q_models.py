"""Registered learner queries (K): fit on the train split of ``embeddings``,
score the test split, report metrics next to the majority-class baseline.

No SQL form exists for a model fit, so these carry no oracle; the check is
that each learner beats (or, for the anomaly detector, is scored against)
the majority baseline in the test suite.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from sparkwright.operators import evaluate as EV
from sparkwright.operators import models as M
from sparkwright.operators import split as SP
from sparkwright.plans.registry import register
from sparkwright.plans.tables import round_doubles, table
from sparkwright.functions.columns import attach_one_row


def embedding_frame(spark, d):
    """``vec_id, features, label`` from ``embeddings`` with an exact 80/20 split."""
    e = table(spark, d, "embeddings")
    df = e.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
                  F.col("label").cast("double").alias("label"))
    return SP.split_random(df, ["vec_id"], 0.2)


def fit_and_score(spark, d, name: str):
    data = embedding_frame(spark, d).persist()
    train = data.where(F.col("split") == "train").drop("split")
    test = data.where(F.col("split") == "test").drop("split")
    mgr = M.ModelManager(spark)
    if name == "Multinomial Naive Bayes":
        # counts-like model: rescale features to [0, 1] with train min/max first
        from pyspark.ml.feature import MinMaxScaler
        mm = MinMaxScaler(inputCol="features", outputCol="__mm").fit(train)
        train = mm.transform(train).drop("features").withColumnRenamed("__mm", "features")
        test = mm.transform(test).drop("features").withColumnRenamed("__mm", "features")
        test = test.withColumn("features", array_to_vector(F.transform(
            vector_to_array("features"), lambda v: F.greatest(v, F.lit(0.0)))))
    model = mgr.train(name, train)
    pred = M.predict(model, test)
    metrics = EV.classification_metrics(pred)
    majority = train.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1) \
        .select(F.col("label").alias("__maj"))
    base = attach_one_row(test, majority).agg(
        F.avg((F.col("label") == F.col("__maj")).cast("double")).alias("majority_accuracy"),
        F.count(F.lit(1)).alias("n_test"))
    out = attach_one_row(metrics, base).select(F.lit(name).alias("model"), "*")
    return round_doubles(out)


def _key(name: str) -> str:
    return "fit_" + name.lower().replace("-", "_").replace(" ", "_")


for _learner in M.LEARNERS:
    register(_key(_learner.name))(lambda spark, d, _n=_learner.name: fit_and_score(spark, d, _n))


_RECO_SQL = (
    "WITH n AS (SELECT count(*) AS dataset_size FROM lineitem), "
    "lists(size_class, rank, model) AS (VALUES " + ", ".join(
        f"('{size}', {i}, '{name}')" for size, _, names in M.SUGGESTED for i, name in enumerate(names)) + ") "
    "SELECT CAST(rank AS INTEGER) AS rank, model, dataset_size FROM lists, n WHERE size_class = "
    "CASE WHEN dataset_size < 1000 THEN 'small' WHEN dataset_size < 10000 THEN 'medium' ELSE 'large' END")


@register("model_recommendations", _RECO_SQL)
def q_model_recommendations(spark, d):
    """Size-based suggestions for a classification target of ``lineitem``."""
    return M.recommendations_frame(table(spark, d, "lineitem"), "classification")


@register("feature_importance")
def q_feature_importance(spark, d):
    """Top-10 importances of a random forest on the embeddings."""
    data = embedding_frame(spark, d)
    train = data.where(F.col("split") == "train")
    model = M.ModelManager(spark).train("Random Forest", train)
    names = [f"embedding_{i}" for i in range(64)]
    return M.feature_importances(model, names, 10)


@register("cv_summary")
def q_cv_summary(spark, d):
    """5-fold stratified cross-validated accuracy of Gaussian naive Bayes on the
    train split: per-fold scores, mean and population std."""
    data = embedding_frame(spark, d).where(F.col("split") == "train").drop("split")
    scores = M.cross_validate("Gaussian Naive Bayes", data, ["vec_id"], k=5)
    return M.cv_summary(scores)


# ------------------------------------------------------------------ regression
_PER_ORDER = ("(SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS x, CAST(sum(l_extendedprice) AS DOUBLE) AS label "
              "FROM lineitem GROUP BY l_orderkey)")


def order_frame(spark, d):
    """Price and quantity of every order: ``l_orderkey, features`` (the quantity) and ``label`` (the price)."""
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").cast("double").alias("x"), F.sum("l_extendedprice").cast("double").alias("label"))
    return per.select("l_orderkey", array_to_vector(F.array("x")).alias("features"), "label")


_R2 = "1 - sum((label - (b + m * x)) * (label - (b + m * x))) / nullif(var_pop(label) * count(*), 0)"
_FOLD_SQL = (f"WITH r AS (SELECT *, CAST(ntile(5) OVER (ORDER BY l_orderkey) - 1 AS INTEGER) AS fold FROM {_PER_ORDER}), "
             "fits AS (SELECT f.fold, regr_slope(label, x) AS m, regr_intercept(label, x) AS b "
             "FROM (SELECT DISTINCT fold FROM r) f JOIN r ON r.fold <> f.fold GROUP BY f.fold), "
             f"scores AS (SELECT r.fold, {_R2} AS score FROM r JOIN fits USING (fold) GROUP BY r.fold) ")


@register("cv_scores_r2", _FOLD_SQL + "SELECT fold, round(score, 6) AS score FROM scores")
def q_cv_scores_r2(spark, d):
    """R2 of a linear regression on each of five contiguous folds of all orders."""
    return round_doubles(M.cross_validate("Linear Regression", order_frame(spark, d), ["l_orderkey"], k=5))


@register("cv_summary_r2", _FOLD_SQL + "SELECT round(avg(score), 6) AS cv_mean, round(stddev_pop(score), 6) AS cv_std, "
          "count(*) AS n_folds FROM scores")
def q_cv_summary_r2(spark, d):
    """Mean and deviation of the folds' R2."""
    scores = M.cross_validate("Linear Regression", order_frame(spark, d), ["l_orderkey"], k=5)
    return round_doubles(M.cv_summary(scores).drop("cv_scores"))


_SPLIT_SQL = (f"(SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(l_orderkey AS VARCHAR)))) "
              f"<= ceil(CAST(count(*) OVER () AS DOUBLE) * 0.2) THEN 'test' ELSE 'train' END AS split FROM {_PER_ORDER})")


@register("fit_linear_regression",
          f"WITH r AS {_SPLIT_SQL}, fit AS (SELECT regr_slope(label, x) AS m, regr_intercept(label, x) AS b FROM r "
          "WHERE split = 'train'), e AS (SELECT label, b + m * x AS p FROM r, fit WHERE split = 'test') "
          "SELECT 'Linear Regression' AS model, count(*) AS n_test, "
          "round(1 - sum((label - p) * (label - p)) / (var_pop(label) * count(*)), 6) AS r2_score, "
          "round(sqrt(avg((label - p) * (label - p))), 4) AS rmse, round(avg(abs(label - p)), 4) AS mae FROM e")
def q_fit_linear_regression(spark, d):
    """Linear regression fitted on the train orders, scored on the others."""
    return regress_and_score(spark, d, "Linear Regression")


def regress_and_score(spark, d, name: str):
    """Fit a regressor on the train orders and score the test ones."""
    data = SP.split_random(order_frame(spark, d), ["l_orderkey"], 0.2).persist()
    model = M.ModelManager(spark).train(name, data.where("split = 'train'").drop("split"))
    pred = M.predict(model, data.where("split = 'test'"))
    metrics = EV.regression_metrics(pred).select("r2_score", "rmse", "mae")
    out = attach_one_row(metrics, pred.agg(F.count(F.lit(1)).alias("n_test"))).select(F.lit(name).alias("model"), "*")
    return round_doubles(out, per_column={"rmse": 4, "mae": 4})


for _learner in M.REGRESSORS[1:]:
    register(_key(_learner.name))(lambda spark, d, _n=_learner.name: regress_and_score(spark, d, _n))


@register("gnb_moments", "SELECT label, count(*) AS n, " + ", ".join(
    f"round(avg(embedding[{i + 1}]), 6) AS mean_{i}, round(var_pop(embedding[{i + 1}]), 6) AS var_{i}"
    for i in range(64)) + " FROM embeddings GROUP BY label")
def q_gnb_moments(spark, d):
    """Per-class feature means and (population) variances behind the
    Gaussian naive Bayes fit (all 64 features)."""
    e = table(spark, d, "embeddings")
    aggs = [F.count(F.lit(1)).alias("n")]
    for i in range(64):
        x = F.col("embedding")[i].cast("double")
        aggs += [F.round(F.avg(x), 6).alias(f"mean_{i}"), F.round(F.var_pop(x), 6).alias(f"var_{i}")]
    return e.groupBy("label").agg(*aggs)


_KNN_SQL = (
    "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS DOUBLE) AS label, "
    "CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(vec_id AS VARCHAR)))) <= "
    "ceil(CAST(count(*) OVER () AS DOUBLE) * 0.2) THEN 'test' ELSE 'train' END AS split FROM embeddings), "
    "tr AS (SELECT x, label, count(*) AS n, md5(array_to_string(x, '|') || '|' || CAST(label AS VARCHAR)) AS t "
    "FROM e WHERE split = 'train' GROUP BY x, label), "
    "te AS (SELECT vec_id, x FROM e WHERE split = 'test'), "
    "d AS (SELECT te.vec_id, tr.label, tr.n, tr.t, list_sum(list_transform(range(1, len(te.x) + 1), "
    "lambda i: (te.x[i] - tr.x[i]) * (te.x[i] - tr.x[i]))) AS d2 FROM te, tr), "
    "r AS (SELECT *, sum(n) OVER (PARTITION BY vec_id ORDER BY d2, t ROWS BETWEEN UNBOUNDED PRECEDING AND "
    "CURRENT ROW) AS cum FROM d), "
    "v AS (SELECT vec_id, label, sum(least(n, 5 - (cum - n))) AS votes FROM r WHERE cum - n < 5 GROUP BY 1, 2) "
    "SELECT vec_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, "
    "label) AS rn FROM v) WHERE rn = 1")


@register("knn_predict", _KNN_SQL)
def q_knn_predict(spark, d):
    """Exact 5-nearest-neighbour vote for every test embedding (brute-force SQL twin)."""
    from sparkwright.operators.knn import KNeighbors
    data = embedding_frame(spark, d).persist()
    train = data.where(F.col("split") == "train").drop("split")
    test = data.where(F.col("split") == "test").drop("split")
    model = KNeighbors(5).fit(train)
    return model.transform(test).select("vec_id", "prediction")

