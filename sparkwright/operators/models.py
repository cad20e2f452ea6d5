"""Learner registry, training, prediction and persistence.

Every learner is an MLlib ``Estimator`` over ``(features: vector, label:
double)``.  Stock MLlib stages are used where they exist; the rest are
small Estimators whose fitting is DataFrame aggregation (class moments,
histograms of binned features) with only fixed-size results on the driver
(d x d matrices, one row per tree node, 100 trees of 256 rows).
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC,
                                       LogisticRegression, MultilayerPerceptronClassifier,
                                       NaiveBayes, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import Binarizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.functions.columns import q
from sparkwright.operators.boosting import AdaBoostSAMME, Rule, TreeBoosting, features_udf, soft, with_classes
from sparkwright.operators.storage import StoredModel, load_model, saved_models
from sparkwright.session import checkpoint_dir, ship_package

SEED = 42


# ===================================================================== assembly
def assemble(df: DataFrame, features: Sequence[str], label: str | None = "label",
             out: str = "features") -> DataFrame:
    """Feature columns -> one double vector; label cast to double."""
    va = VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")
    res = va.transform(df)
    if label is not None and label in df.columns:
        res = res.withColumn("label", q(label).cast("double"))
    return res


def n_classes(df: DataFrame, label: str = "label") -> int:
    return int(df.agg(F.max(q(label))).first()[0] or 0) + 1


# ===================================================================== custom learners
class NumpyClassifier(StoredModel):
    """Class scores from a numpy function of the features; its state is a few small arrays."""

    probabilities = True

    def __init__(self, state: dict):
        super().__init__()
        self.state = state

    def _scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        return with_classes(dataset, features_udf(self._scorer(), F.col("features")), soft() if self.probabilities else None)

    def _state(self) -> dict:
        return self.state

    @classmethod
    def _rebuilt(cls, state: dict, tables: dict) -> "NumpyClassifier":
        return cls(state)


def _class_moments(df: DataFrame, d: int, full: bool = True) -> dict:
    """Per class: count, mean vector and scatter matrix.

    Each task folds its rows into per-class counts, means and scatter matrices
    around the mean (merged pairwise, so nothing cancels far from zero); one
    small partial per class and task is merged per class in a second step.  The
    driver receives k * (1 + d + d^2) numbers: bounded by the feature count.
    """
    import pandas as pd
    base = df.select(F.col("label").cast("double").alias("label"), vector_to_array("features").alias("__x"))

    def merge(a, b):
        n = a[0] + b[0]
        shift = b[1] - a[1]
        scatter = a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n) if full else None
        return n, a[1] + shift * (b[0] / n), scatter

    def frame(acc):
        return pd.DataFrame({"label": list(acc), "v": [
            np.concatenate([[n], mean, scatter.ravel() if full else []]).tolist() for n, mean, scatter in acc.values()]})

    def part(it):
        acc: dict = {}
        for pdf in it:
            if not len(pdf):
                continue
            X = np.array(pdf["__x"].tolist(), dtype=float)
            y = pdf["label"].to_numpy()
            for c in np.unique(y):
                Xc = X[y == c]
                mean = Xc.mean(axis=0)
                one = (float(len(Xc)), mean, (Xc - mean).T @ (Xc - mean) if full else None)
                acc[c] = merge(acc[c], one) if c in acc else one
        if acc:                    # a task without rows has no partial
            yield frame(acc)

    def total(pdf):
        out = None
        for v in pdf["v"]:
            v = np.array(v)
            one = (v[0], v[1:1 + d], v[1 + d:].reshape(d, d) if full else None)
            out = one if out is None else merge(out, one)
        return frame({pdf["label"].iloc[0]: out})

    schema = "label double, v array<double>"
    # partials of a class are merged in two steps, so no task reads one from every other task
    parts = base.mapInPandas(part, schema).withColumn("slot", F.spark_partition_id() % 64)
    halves = parts.groupBy("label", "slot").applyInPandas(total, schema)
    out = {}
    for r in halves.groupBy("label").applyInPandas(total, schema).collect():
        v = np.array(r["v"])
        m = {"n": int(round(v[0])), "mean": v[1:1 + d]}
        if full:
            m["scatter"] = v[1 + d:].reshape(d, d)
        out[int(r["label"])] = m
    return out


def _dims(df: DataFrame) -> int:
    return len(df.select("features").first()[0])


class LinearDiscriminant(Estimator):
    """Shared covariance (pooled scatter / (n - k)); linear scores + log priors."""

    def _fit(self, df: DataFrame):
        d = _dims(df)
        mom = _class_moments(df, d)
        classes = sorted(mom)
        n = sum(m["n"] for m in mom.values())
        cov = sum(m["scatter"] for m in mom.values()) / max(n - len(classes), 1)
        inv = np.linalg.pinv(cov)
        centre = sum(m["n"] * m["mean"] for m in mom.values()) / n  # scores are taken around it
        coefs = []
        for c in range(max(classes) + 1):
            if c not in mom:
                coefs.append({"w": [0.0] * d, "b": -1e300})
                continue
            mu = mom[c]["mean"] - centre
            w = inv @ mu
            coefs.append({"w": w.tolist(), "b": float(-0.5 * mu @ w + math.log(mom[c]["n"] / n))})
        return LinearDiscriminantModel({"coefs": coefs, "centre": centre.tolist()})


class LinearDiscriminantModel(NumpyClassifier):
    def _scorer(self):
        W = np.array([c["w"] for c in self.state["coefs"]], dtype=float)
        b = np.array([c["b"] for c in self.state["coefs"]], dtype=float)
        centre = np.array(self.state["centre"], dtype=float)
        return lambda X: (X - centre) @ W.T + b


class QuadraticDiscriminant(Estimator):
    """Per-class covariance (ddof=1); quadratic scores + log priors."""

    def __init__(self, reg_param: float = 0.0):
        super().__init__()
        self.reg_param = reg_param

    def _fit(self, df: DataFrame):
        d = _dims(df)
        mom = _class_moments(df, d)
        n = sum(m["n"] for m in mom.values())
        parts = []
        for c in range(max(mom) + 1):
            if c not in mom:
                parts.append(None)
                continue
            m = mom[c]
            cov = m["scatter"] / max(m["n"] - 1, 1)
            cov = (1 - self.reg_param) * cov + self.reg_param * np.eye(d)
            sign, logdet = np.linalg.slogdet(cov)
            parts.append({"mu": m["mean"].tolist(), "inv": np.linalg.pinv(cov).tolist(),
                          "c": float(-0.5 * (logdet if sign > 0 else 0.0) + math.log(m["n"] / n))})
        return QuadraticDiscriminantModel({"parts": parts})


class QuadraticDiscriminantModel(NumpyClassifier):
    def _scorer(self):
        parts = [None if p is None else (np.array(p["mu"]), np.array(p["inv"]), p["c"]) for p in self.state["parts"]]

        def fn(X):
            out = np.full((X.shape[0], len(parts)), -1e300)
            for k, p in enumerate(parts):
                if p is None:
                    continue
                D = X - p[0]
                out[:, k] = p[2] - 0.5 * np.einsum("ij,jk,ik->i", D, p[1], D)
            return out
        return fn


class RidgeClassifierSpark(Estimator):
    """Targets +-1 per class, ridge least squares (alpha), argmax of scores."""

    def __init__(self, alpha: float = 1.0):
        super().__init__()
        self.alpha = alpha

    def _fit(self, df: DataFrame):
        k = n_classes(df)
        n = df.count()
        heads = [1] if k <= 2 else list(range(k))
        models = []
        for c in heads:
            t = df.withColumn("__t", F.when(F.col("label") == c, 1.0).otherwise(-1.0))
            lr = LinearRegression(featuresCol="features", labelCol="__t", regParam=self.alpha / n,
                                  elasticNetParam=0.0, standardization=False, solver="normal")
            m = lr.fit(t)
            models.append({"w": m.coefficients.toArray().tolist(), "b": float(m.intercept)})
        return RidgeClassifierModel({"models": models, "binary": k <= 2})


class RidgeClassifierModel(NumpyClassifier):
    probabilities = False

    def _scorer(self):
        W = np.array([m["w"] for m in self.state["models"]], dtype=float)
        b = np.array([m["b"] for m in self.state["models"]], dtype=float)
        if self.state["binary"]:
            return lambda X: np.column_stack([-(X @ W[0] + b[0]), X @ W[0] + b[0]])
        return lambda X: X @ W.T + b


# ===================================================================== registry
@dataclass(frozen=True)
class Learner:
    name: str
    category: str
    build: Callable[[dict, dict], object]   # (params, context) -> Estimator
    supports_probability: bool
    cls: str


def _rf(p, ctx):
    return RandomForestClassifier(numTrees=int(p.get("n_estimators", 100)), maxDepth=int(p.get("max_depth", 10)),
                                  minInstancesPerNode=int(p.get("min_samples_leaf", 1)), seed=SEED)


def _dt(p, ctx):
    return DecisionTreeClassifier(maxDepth=int(p.get("max_depth", 10)), impurity=p.get("criterion", "gini"),
                                  minInstancesPerNode=int(p.get("min_samples_leaf", 1)), seed=SEED)


def _boosted(rule: Rule, regression: bool = False):
    """Boosted trees with a learner's own defaults; its parameters change rounds, depth, rate and sampling."""
    def build(p, ctx):
        own = replace(rule, depth=int(p.get("max_depth", rule.depth)), rate=float(p.get("learning_rate", rule.rate)),
                      l2=float(p.get("reg_lambda", rule.l2)), leaves=int(p.get("num_leaves", rule.leaves)))
        return TreeBoosting(int(p.get("n_estimators", 100)), own, float(p.get("subsample", 1.0)),
                            float(p.get("colsample", 1.0)), regression)
    return build


# Growth of the boosted learners, after the libraries of these names: plain gradients; regularised Newton steps;
# the best nodes first up to a number of leaves; one split for a whole level.
PLAIN = Rule(depth=3, rate=0.1, newton=False)
NEWTON = Rule(depth=6, rate=0.3, l2=1.0, min_hessian=1.0)
BEST_LEAVES = Rule(growth="leaves", depth=6, leaves=31, rate=0.1, min_rows=20, min_hessian=1e-3)
OBLIVIOUS = Rule(growth="oblivious", depth=6, rate=0.1, l2=3.0)


def _logreg(p, ctx):
    C = float(p.get("C", 1.0))
    penalty = p.get("penalty", "l2")
    return LogisticRegression(maxIter=int(p.get("max_iter", 1000)), regParam=1.0 / (C * ctx["n"]),
                              elasticNetParam=1.0 if penalty == "l1" else 0.0, standardization=False)


def _svc(reg):
    def build(p, ctx):
        lam = reg(p, ctx)
        svc = LinearSVC(regParam=lam, maxIter=int(p.get("max_iter", 100)), standardization=False)
        return svc if ctx["k"] <= 2 else OneVsRest(classifier=svc, parallelism=4)
    return build


def _mlp(p, ctx):
    hidden = list(p.get("hidden_layer_sizes", [100]))
    return MultilayerPerceptronClassifier(layers=[ctx["d"], *hidden, max(ctx["k"], 2)],
                                          maxIter=int(p.get("max_iter", 1000)), seed=SEED)


def _bernoulli(p, ctx):
    return Pipeline(stages=[Binarizer(threshold=0.0, inputCol="features", outputCol="__bin"),
                            NaiveBayes(modelType="bernoulli", featuresCol="__bin")])


def _bagging(p, ctx):
    return RandomForestClassifier(numTrees=int(p.get("n_estimators", 10)), featureSubsetStrategy="all",
                                  subsamplingRate=1.0, bootstrap=True, maxDepth=int(p.get("max_depth", 10)),
                                  seed=SEED)


def _knn(p, ctx):
    from sparkwright.operators.knn import KNeighbors
    return KNeighbors(k=int(p.get("n_neighbors", 5)))


def _iforest(p, ctx):
    from sparkwright.operators.iforest import IsolationForestSpark
    return IsolationForestSpark(n_trees=int(p.get("n_estimators", 100)), max_samples=int(p.get("max_samples", 256)))


# Learner names and categories (fixed values).
LEARNERS = [
    Learner("Random Forest", "Tree-based", _rf, True, "RandomForestClassifier"),
    Learner("Decision Tree", "Tree-based", _dt, True, "DecisionTreeClassifier"),
    Learner("Gradient Boosting", "Boosting", _boosted(PLAIN), True, "TreeBoosting"),
    Learner("AdaBoost", "Boosting", lambda p, ctx: AdaBoostSAMME(int(p.get("n_estimators", 50)),
                                                                 float(p.get("learning_rate", 1.0))),
            True, "AdaBoostSAMME"),
    Learner("XGBoost", "Boosting", _boosted(NEWTON), True, "TreeBoosting"),
    Learner("LightGBM", "Boosting", _boosted(BEST_LEAVES), True, "TreeBoosting"),
    Learner("CatBoost", "Boosting", _boosted(OBLIVIOUS), True, "TreeBoosting"),
    Learner("Logistic Regression", "Linear", _logreg, True, "LogisticRegression"),
    Learner("Ridge Classifier", "Linear", lambda p, ctx: RidgeClassifierSpark(float(p.get("alpha", 1.0))),
            False, "RidgeClassifierSpark"),
    Learner("SGD Classifier", "Linear", _svc(lambda p, ctx: float(p.get("alpha", 1e-4))), False, "LinearSVC"),
    Learner("Gaussian Naive Bayes", "Probabilistic", lambda p, ctx: NaiveBayes(modelType="gaussian"),
            True, "NaiveBayes"),
    Learner("Bernoulli Naive Bayes", "Probabilistic", _bernoulli, True, "NaiveBayes"),
    Learner("Multinomial Naive Bayes", "Probabilistic",
            lambda p, ctx: NaiveBayes(modelType="multinomial", smoothing=float(p.get("alpha", 1.0))),
            True, "NaiveBayes"),
    Learner("K-Nearest Neighbors", "Instance-based", _knn, True, "KNeighbors"),
    Learner("Multi-layer Perceptron", "Neural Networks", _mlp, True, "MultilayerPerceptronClassifier"),
    Learner("Support Vector Machine", "Support Vector Machines",
            _svc(lambda p, ctx: 1.0 / (float(p.get("C", 1.0)) * ctx["n"])), False, "LinearSVC"),
    Learner("Bagging Classifier", "Ensemble", _bagging, True, "RandomForestClassifier"),
    Learner("Linear Discriminant Analysis", "Discriminant Analysis", lambda p, ctx: LinearDiscriminant(),
            True, "LinearDiscriminant"),
    Learner("Quadratic Discriminant Analysis", "Discriminant Analysis",
            lambda p, ctx: QuadraticDiscriminant(float(p.get("reg_param", 0.0))), True, "QuadraticDiscriminant"),
    Learner("Isolation Forest", "Anomaly Detection", _iforest, False, "IsolationForestSpark"),
]
REGISTRY = {lr.name: lr for lr in LEARNERS}


# ===================================================================== regressors
def _linear_regression(p, ctx):
    return LinearRegression(regParam=float(p.get("alpha", 0.0)) / max(ctx["n"], 1), elasticNetParam=0.0,
                            standardization=False, solver="normal" if ctx["d"] <= 4096 else "l-bfgs")


def _tree_regression(p, ctx):
    return DecisionTreeRegressor(maxDepth=int(p.get("max_depth", 10)),
                                 minInstancesPerNode=int(p.get("min_samples_leaf", 1)), seed=SEED)


def _forest_regression(p, ctx):
    return RandomForestRegressor(numTrees=int(p.get("n_estimators", 100)), maxDepth=int(p.get("max_depth", 10)),
                                 minInstancesPerNode=int(p.get("min_samples_leaf", 1)), seed=SEED)


REGRESSORS = [
    Learner("Linear Regression", "Linear", _linear_regression, False, "LinearRegression"),
    Learner("Decision Tree Regressor", "Tree-based", _tree_regression, False, "DecisionTreeRegressor"),
    Learner("Random Forest Regressor", "Tree-based", _forest_regression, False, "RandomForestRegressor"),
    Learner("Gradient Boosting Regressor", "Boosting", _boosted(PLAIN, True), False, "TreeBoosting"),
    Learner("XGBoost Regressor", "Boosting", _boosted(NEWTON, True), False, "TreeBoosting"),
]
REGRESSOR_NAMES = {lr.name for lr in REGRESSORS}
REGISTRY |= {lr.name: lr for lr in REGRESSORS}


def list_regressors() -> list[str]:
    return [lr.name for lr in REGRESSORS]


def list_models() -> list[str]:
    return [lr.name for lr in LEARNERS]


def models_by_category(category: str) -> list[str]:
    return [lr.name for lr in LEARNERS if lr.category == category]


def categories() -> list[str]:
    seen = []
    for lr in LEARNERS:
        if lr.category not in seen:
            seen.append(lr.category)
    return seen


def model_info(name: str) -> dict:
    lr = get_learner(name)
    return {"name": lr.name, "category": lr.category, "class": lr.cls,
            "supports_probability": lr.supports_probability}


def get_learner(name: str) -> Learner:
    if name not in REGISTRY:
        raise ValueError(f"there is no learner called {name!r}; known are {sorted(REGISTRY)}")
    return REGISTRY[name]


# Learners suggested below each number of rows (fixed values; None: any number).
SUGGESTED = [
    ("small", 1000, ["Random Forest", "Gaussian Naive Bayes", "K-Nearest Neighbors"]),
    ("medium", 10000, ["Random Forest", "XGBoost", "Support Vector Machine", "Logistic Regression"]),
    ("large", None, ["XGBoost", "LightGBM", "Random Forest", "Multi-layer Perceptron"]),
]


def recommendations(task_type: str, dataset_size: int) -> list[str]:
    """Learners suggested by data size; classification only."""
    if task_type.lower() != "classification":
        return []
    return next(list(names) for _, below, names in SUGGESTED if below is None or dataset_size < below)


def recommendations_frame(df: DataFrame, task_type: str) -> DataFrame:
    """Recommendations for a table's size (``count(*)`` + the size rule)."""
    n = df.count()
    rows = [(i, name, n) for i, name in enumerate(recommendations(task_type, n))]
    return df.sparkSession.createDataFrame(rows, "rank int, model string, dataset_size bigint")


# ===================================================================== manager
class ModelManager:
    """Train by name, keep fitted models and a history table, save and load.

    Models without a path of their own are saved below ``folder``, which is in the
    shared checkpoint folder unless another one is named.
    """

    def __init__(self, spark, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/saved-models"
        self.trained: dict[str, object] = {}
        self.history: list[tuple] = []

    def train(self, name: str, train_df: DataFrame, params: dict | None = None):
        learner = get_learner(name)
        n = train_df.count()
        k = 1 if name in REGRESSOR_NAMES else n_classes(train_df)
        ctx = {"n": max(n, 1), "k": k, "d": _dims(train_df)}
        est = learner.build(dict(params or {}), ctx)
        model = est.fit(train_df)
        self.trained[name] = model
        self.history.append((name, time.strftime("%Y-%m-%d %H:%M:%S"), json.dumps(params or {}), n))
        return model

    def get(self, name: str):
        if name not in self.trained:
            raise ValueError(f"{name!r} is not fitted here")
        return self.trained[name]

    def history_frame(self) -> DataFrame:
        return self.spark.createDataFrame(
            self.history, "model_name string, timestamp string, parameters string, training_samples bigint")

    def train_many(self, names: Sequence[str], train_df: DataFrame, params: dict | None = None,
                   parallel: int = 1) -> DataFrame:
        """Train in list order; a failure is recorded, the rest go on.
        ``parallel`` > 1 submits fits from driver threads (independent jobs)."""
        params = params or {}
        results = {}

        def run(name):
            t0 = time.time()
            try:
                self.train(name, train_df, params.get(name))
                return (name, "ok", None, time.time() - t0)
            except Exception as e:  # noqa: BLE001 - recorded per model
                return (name, "failed", f"{type(e).__name__}: {e}"[:500], time.time() - t0)
        if parallel > 1:
            from concurrent.futures import ThreadPoolExecutor
            with ThreadPoolExecutor(parallel) as pool:
                for r in pool.map(run, names):
                    results[r[0]] = r
        else:
            for name in names:
                results[name] = run(name)
        rows = [(i, *results[n]) for i, n in enumerate(names)]
        return self.spark.createDataFrame(rows, "position int, model string, status string, error string, seconds double")

    def save(self, name: str, path: str | None = None) -> str:
        """Write a fitted model and return its path, by default the learner's name and the time below ``folder``."""
        model = self.get(name)
        if path is None:
            path = f"{self.folder}/{name.replace(' ', '_')}_{time.strftime('%Y%m%d_%H%M%S')}"
        model.write().overwrite().save(path)
        return path

    def load(self, path: str, name: str | None = None):
        """Read a model of any kind; it counts as fitted here if it gets a name."""
        model = load_model(self.spark, path)
        if name:
            self.trained[name] = model
        return model

    def saved(self) -> list[str]:
        """Names of the models below ``folder``."""
        return saved_models(self.spark, self.folder)


# ===================================================================== predictions
def predict(model, df: DataFrame) -> DataFrame:
    """``prediction`` (double) and, when the learner has one, ``probability``
    as an array of doubles indexed by class code."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("probability", vector_to_array(F.col("probability")))
    return out


def feature_importances(model, feature_names: Sequence[str], top: int = 10) -> DataFrame | None:
    """Top-``top`` importances of a tree model (``None`` for other learners)."""
    m = model.stages[-1] if isinstance(model, PipelineModel) else model
    if not hasattr(m, "featureImportances"):
        return None
    imp = m.featureImportances.toArray().tolist()
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = [(f, float(v)) for f, v in zip(feature_names, imp)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("feature", T.StringType()),
                                                   T.StructField("importance", T.DoubleType())]))
    return df.orderBy(F.desc("importance"), "feature").limit(top)


def evaluate_model(name: str, model, test: DataFrame, id_cols: Sequence[str], params: dict | None = None,
                   feature_names: Sequence[str] | None = None, cv: bool = True):
    """The whole evaluation of a fitted classifier on a test set, with cross-validated accuracies on the same
    set (more than 10 rows) and, for learners that have them, feature importances."""
    from sparkwright.operators import evaluate as EV
    pred = predict(model, test)
    out = EV.evaluate_classification(pred, probability="probability" if "probability" in pred.columns else None)
    if cv:
        out.cv = cross_validate(name, test, id_cols, params=params)
    if feature_names is not None:
        out.importances = feature_importances(model, feature_names, len(feature_names))
    return out


def cross_validate(name: str, df: DataFrame, id_cols: Sequence[str], k: int | None = None,
                   params: dict | None = None, scoring: str | None = None, stratified: bool | None = None,
                   order_by: Sequence[str] | None = None) -> DataFrame:
    """k-fold scores (fit on k-1 folds, score the held-out one): ``fold, score``.

    Classifiers are scored by accuracy over stratified folds, regressors by R2 over
    contiguous ones (``stratified`` and ``scoring`` override).  k defaults to
    min(5, n // 2); nothing for n <= 10.  Any frame can be given, a test set too.
    """
    from sparkwright.operators import evaluate as EV
    from sparkwright.operators.split import cv_folds, cv_folds_plain, default_folds
    regression = name in REGRESSOR_NAMES
    scoring = scoring or ("r2" if regression else "accuracy")
    stratified = not regression if stratified is None else stratified
    n = df.count()
    k = k or default_folds(n)
    spark = df.sparkSession
    if k < 2:
        return spark.createDataFrame([], "fold int, score double")
    folded = cv_folds(df, id_cols, "label", k) if stratified else cv_folds_plain(df, order_by or id_cols, k)
    folded = folded.persist()
    mgr = ModelManager(spark)
    rows = []
    try:
        for f in range(k):
            pred = predict(mgr.train(name, folded.where(F.col("fold") != f), params), folded.where(F.col("fold") == f))
            if scoring == "accuracy":
                s = EV.classification_metrics(pred).first()["accuracy"]
            else:
                s = EV.regression_metrics(pred).first()["r2_score"]
            rows.append((f, float(s)))
    finally:
        folded.unpersist()
    return spark.createDataFrame(rows, "fold int, score double")


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of the folds' scores, their number and the scores themselves in fold order."""
    return scores.agg(F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"),
                      F.count(F.lit(1)).alias("n_folds"),
                      F.transform(F.sort_array(F.collect_list(F.struct("fold", "score"))), lambda r: r["score"])
                      .alias("cv_scores"))
