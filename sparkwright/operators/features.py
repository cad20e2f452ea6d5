"""Options the reference advertises in its forms:
class balancing, univariate feature scores, extra encodings, derived
features, collinear-feature removal, PCA and parameter search.

Every fit is one grouped aggregate (per class or per category); category
dictionaries are joined back like the other encoders.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.columns import q
from sparkwright.operators.encode import label_dictionary, as_text
from sparkwright.functions.columns import attach_one_row
from sparkwright.session import cut_lineage


# --------------------------------------------------------------------- P2
def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``(label, n_c, weight)`` with weight = n / (k * n_c) (balanced)."""
    counts = df.groupBy(q(label).alias(label)).agg(F.count(F.lit(1)).alias("n_c"))
    tot = counts.agg(F.sum("n_c").alias("__n"), F.count(F.lit(1)).alias("__k"))
    return attach_one_row(counts, tot).select(
        q(label), "n_c", (F.col("__n") / (F.col("__k") * F.col("n_c"))).alias("weight"))


def add_balance_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Inverse-frequency row weights (a ``weightCol`` for MLlib learners)."""
    w = class_weights(df, label)
    return df.join(w.select(q(label), F.col("weight").alias(out)), label, "left")


# --------------------------------------------------------------------- P3
def anova_f_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One-way ANOVA F statistic of each feature against the class label
    (between-class over within-class mean squares), from one groupBy.

    Each class gives its count, mean and variance (merged around the mean by the engine), and classes are
    weighed around the overall mean, so nothing cancels far from zero.
    """
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(features):
        x = q(c).cast("double")
        aggs += [F.avg(x).alias(f"__m{i}"), F.var_pop(x).alias(f"__v{i}"), F.count(x).alias(f"__c{i}")]
    per = df.groupBy(q(label)).agg(*aggs)
    tot = [F.sum("__n").alias("N"), F.count(F.lit(1)).alias("K")]
    for i in range(len(features)):
        # the spread of class means, weighed by class size, is a variance as well: merge the means themselves
        tot += [F.sum(F.col(f"__v{i}") * F.col(f"__c{i}")).alias(f"W{i}"),
                F.sort_array(F.collect_list(F.struct(f"__m{i}", f"__c{i}"))).alias(f"M{i}")]     # one entry per class
    t = per.agg(*tot)

    def between(i: int):
        mean, size = f"__m{i}", f"__c{i}"
        means = F.filter(F.col(f"M{i}"), lambda e: e[mean].isNotNull())
        first = F.element_at(means, 1)[mean]        # sums are taken around one of the means
        n = F.aggregate(means, F.lit(0.0), lambda a, e: a + e[size])
        s1 = F.aggregate(means, F.lit(0.0), lambda a, e: a + e[size] * (e[mean] - first))
        s2 = F.aggregate(means, F.lit(0.0), lambda a, e: a + e[size] * (e[mean] - first) * (e[mean] - first))
        return F.when(F.size(means) > 0, s2 - s1 * F.try_divide(s1, n))

    structs = [F.struct(F.lit(c).alias("feature"), F.try_divide(
        F.try_divide(between(i), F.col("K") - 1), F.try_divide(F.col(f"W{i}"), F.col("N") - F.col("K"))).alias("f_score"))
        for i, c in enumerate(features)]
    return t.select(F.inline(F.array(*structs)))


def select_k_best(df: DataFrame, features: Sequence[str], label: str, k: int) -> list[str]:
    """Names of the k features with the highest F score (feature list is schema-bounded)."""
    rows = anova_f_scores(df, features, label).orderBy(F.desc("f_score"), "feature").limit(k).collect()
    return [r["feature"] for r in rows]


# --------------------------------------------------------------------- P11
def encode_binary(df: DataFrame, column: str) -> DataFrame:
    """Binary digits of the sorted-value code: ``<col>_bin_<i>`` (most significant first)."""
    d = label_dictionary(df, column)
    n = d.count()
    bits = max(1, math.ceil(math.log2(max(n, 2))))
    j = df.withColumn("__bk", as_text(q(column))).join(
        d.select(F.col("value").alias("__bk"), F.col("code").alias("__bc")), "__bk", "left")
    digits = [F.shiftright(F.col("__bc"), bits - 1 - i).bitwiseAND(F.lit(1)).cast("int").alias(f"{column}_bin_{i}")
              for i in range(bits)]
    return j.select(*[q(c) for c in df.columns if c != column], *digits)


def encode_target_mean(df: DataFrame, column: str, target: str, fit_where=None,
                       smoothing: float = 0.0) -> DataFrame:
    """Replace a category by the (optionally smoothed) mean target of its
    rows, fitted on ``fit_where`` rows; unseen categories get the global mean."""
    fit = df.where(fit_where) if fit_where is not None else df
    y = q(target).cast("double")
    glob = fit.agg(F.avg(y).alias("__g"))
    stats = fit.groupBy(q(column).alias("__tk")).agg(F.sum(y).alias("__sy"), F.count(y).alias("__ny"))
    stats = attach_one_row(stats, glob).select(
        "__tk", ((F.col("__sy") + F.lit(smoothing) * F.col("__g")) / (F.col("__ny") + F.lit(smoothing))).alias("__te"))
    j = attach_one_row(df.join(stats, q(column) == F.col("__tk"), "left"), glob)
    return j.select(*[F.coalesce(F.col("__te"), F.col("__g")).alias(c) if c == column else q(c)
                      for c in df.columns])


def encode_hash(df: DataFrame, column: str, n_buckets: int = 32) -> DataFrame:
    """Feature hashing into ``n_buckets``: bucket = first 8 hex digits of
    md5(value) mod n (reproducible in SQL); missing stays missing."""
    h = F.conv(F.substring(F.md5(q(column).cast("string")), 1, 8), 16, 10).cast("bigint") % n_buckets
    return df.select(*[F.when(q(c).isNotNull(), h).alias(c) if c == column else q(c) for c in df.columns])


# --------------------------------------------------------------------- P12
def polynomial_features(df: DataFrame, columns: Sequence[str], degree: int = 2,
                        interactions_only: bool = False) -> DataFrame:
    """Squares (unless ``interactions_only``) and pairwise products ``a*b``."""
    cols = list(columns)
    extra = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            if a == b and (interactions_only or degree < 2):
                continue
            extra.append((q(a).cast("double") * q(b).cast("double")).alias(f"{a}^2" if a == b else f"{a}*{b}"))
    return df.select("*", *extra)


def derived_features(df: DataFrame, columns: Sequence[str], kinds: Sequence[str] = ("log", "sqrt", "reciprocal")):
    """``<col>_log`` (log1p, x > -1), ``<col>_sqrt`` (x >= 0), ``<col>_reciprocal`` (x != 0)."""
    extra = []
    for c in columns:
        x = q(c).cast("double")
        if "log" in kinds:
            extra.append(F.when(x > -1, F.log1p(x)).alias(f"{c}_log"))
        if "sqrt" in kinds:
            extra.append(F.when(x >= 0, F.sqrt(x)).alias(f"{c}_sqrt"))
        if "reciprocal" in kinds:
            extra.append(F.when(x != 0, F.lit(1.0) / x).alias(f"{c}_reciprocal"))
    return df.select("*", *extra)


# --------------------------------------------------------------------- P13
def collinear_to_drop(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> list[str]:
    """Greedy in column order: for each pair (earlier, later) with
    |corr| > threshold whose earlier column is kept, drop the later one.
    The correlations come from one aggregate; the greedy pass runs on the
    (columns x columns) result."""
    from sparkwright.operators.profile import correlation_pairs
    corr = {(r["col_a"], r["col_b"]): r["corr"] for r in correlation_pairs(df, list(columns)).collect()}
    dropped: list[str] = []
    cols = list(columns)
    for j, b in enumerate(cols):
        for a in cols[:j]:
            r = corr.get((b, a))
            if a not in dropped and b not in dropped and r is not None and not math.isnan(r) \
                    and abs(r) > threshold:
                dropped.append(b)
    return dropped


# --------------------------------------------------------------------- P1
def pca_keep_variance(df: DataFrame, share: float = 0.95, input_col: str = "features",
                      output_col: str = "pca_features"):
    """PCA keeping the fewest components whose explained variance reaches
    ``share``; returns (model, k, cumulative explained variance).  One fit: the
    model is the full PCA and a slicer of its first k components."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import PCA, VectorSlicer
    d = len(df.select(input_col).first()[0])
    full = PCA(k=d, inputCol=input_col, outputCol=output_col + "_all").fit(df)
    ev = full.explainedVariance.toArray()
    cum = 0.0
    k = d
    for i, v in enumerate(ev):
        cum += v
        if cum >= share - 1e-12:
            k = i + 1
            break
    first = VectorSlicer(inputCol=output_col + "_all", outputCol=output_col, indices=list(range(k)))
    return PipelineModel(stages=[full, first]), k, float(sum(ev[:k]))


# --------------------------------------------------------------------- P14
def grid_search(estimator, grid: dict, df: DataFrame, folds: int = 3, metric: str = "accuracy",
                parallelism: int = 4, seed: int = 42):
    """Cross-validated grid search (MLlib ``CrossValidator``, models fitted
    ``parallelism`` at a time); returns (best model, per-combination scores)."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    builder = ParamGridBuilder()
    for param_name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(param_name), list(values))
    maps = builder.build()
    ev = MulticlassClassificationEvaluator(metricName=metric)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=ev, numFolds=folds,
                        parallelism=parallelism, seed=seed)
    model = cv.fit(df)
    rows = []
    for pm, score in zip(maps, model.avgMetrics):
        rows.append((", ".join(f"{p.name}={v}" for p, v in pm.items()), float(score)))
    scores = df.sparkSession.createDataFrame(rows, "params string, score double")
    return model.bestModel, scores


def _draw(spec, rng):
    """A value of a distribution: a list of choices, ``(low, high)`` or ``("log", low, high)``."""
    if isinstance(spec, list):
        return spec[int(rng.integers(len(spec)))]
    if spec[0] == "log":
        return float(math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2]))))
    low, high = spec
    return int(rng.integers(low, high + 1)) if isinstance(low, int) and isinstance(high, int) else float(rng.uniform(low, high))


def candidates(distributions: dict, n_iter: int, seed: int = 42) -> list[dict]:
    """``n_iter`` different parameter sets drawn with a seed; all of them where lists hold no more."""
    from itertools import product
    names = sorted(distributions)
    if all(isinstance(distributions[c], list) for c in names):
        every = [dict(zip(names, values)) for values in product(*[distributions[c] for c in names])]
        if len(every) <= n_iter:
            return every
    rng = np.random.default_rng(seed)
    out: list[dict] = []
    while len(out) < n_iter:
        one = {c: _draw(distributions[c], rng) for c in names}
        if one not in out:
            out.append(one)
    return out


def random_search(name: str, distributions: dict, df: DataFrame, id_cols: Sequence[str], n_iter: int = 10,
                  folds: int = 3, keep: float = 0.5, seed: int = 42):
    """Seeded random search over a learner's parameters; poor candidates stop early.

    Candidates are scored fold by fold (accuracy, or R2 for regressors); after each fold but the last, the better
    share ``keep`` (by mean so far, at least one) goes on.  Returns the best candidate refitted on all of ``df``, its
    parameters and ``(candidate, params, folds, score)`` of all.
    """
    from sparkwright.operators import evaluate as EV
    from sparkwright.operators import models as M
    from sparkwright.operators.split import cv_folds, cv_folds_plain
    spark = df.sparkSession
    regression = name in M.REGRESSOR_NAMES
    drawn = candidates(distributions, n_iter, seed)
    folded = cut_lineage(cv_folds_plain(df, id_cols, folds) if regression else cv_folds(df, id_cols, "label", folds, seed))
    scores: list[list[float]] = [[] for _ in drawn]
    alive = list(range(len(drawn)))
    manager = M.ModelManager(spark)
    for f in range(folds):
        train, held = folded.where(F.col("fold") != f).drop("fold"), folded.where(F.col("fold") == f)
        for i in alive:
            pred = M.predict(manager.train(name, train, drawn[i]), held)
            metric = EV.regression_metrics(pred).first()["r2_score"] if regression else EV.classification_metrics(pred).first()["accuracy"]
            scores[i].append(float(metric))
        if f < folds - 1:
            ranked = sorted(alive, key=lambda i: (-sum(scores[i]) / len(scores[i]), i))
            alive = sorted(ranked[:max(1, math.ceil(keep * len(alive)))])
    best = min(alive, key=lambda i: (-sum(scores[i]) / len(scores[i]), i))
    rows = [(i, ", ".join(f"{k}={v}" for k, v in p.items()), len(s), sum(s) / len(s)) for i, (p, s) in enumerate(zip(drawn, scores))]
    return manager.train(name, df, drawn[best]), drawn[best], \
        spark.createDataFrame(rows, "candidate int, params string, folds int, score double")
