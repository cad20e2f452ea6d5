"""Evaluation over a ``(label, prediction[, score | probability])`` frame.

Everything reduces to small aggregates: a ``groupBy(label, prediction)``
count table (k^2 cells for k classes) for the count metrics, and a
``groupBy(score)`` table with blockwise running sums (no single-task window)
for AUC and the curves.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.columns import q
from sparkwright.operators import ordered
from sparkwright.functions.columns import attach_one_row
from sparkwright.session import cut_lineage

EPS = sys.float_info.epsilon      # probability clip for log loss (float64 eps)
LOWER_IS_BETTER = {"mse", "mae", "rmse", "mape", "log_loss"}


def _pairs(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(q(label).alias("y"), q(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def per_class_counts(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Per class (union of true and predicted values): tp, true count, predicted count."""
    return _class_counts(_pairs(df, label, pred))


def _class_counts(pairs: DataFrame) -> DataFrame:
    t = pairs.groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("n_true"),
                                                  F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))
                                                        .otherwise(0)).alias("tp"))
    p = pairs.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("n_pred"))
    out = t.join(p, "cls", "full_outer")
    return out.select("cls", F.coalesce("tp", F.lit(0)).cast("bigint").alias("tp"),
                      F.coalesce("n_true", F.lit(0)).cast("bigint").alias("n_true"),
                      F.coalesce("n_pred", F.lit(0)).cast("bigint").alias("n_pred"))


def _prf(c: DataFrame) -> DataFrame:
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    rec = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(0.0)
    c = c.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return c.withColumn("f1", f1)


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """One row: accuracy, support-weighted precision / recall / F1 (0 on a zero
    division), Cohen's kappa and the multi-class Matthews correlation."""
    return _metrics(per_class_counts(df, label, pred))


def _metrics(counts: DataFrame) -> DataFrame:
    c = _prf(counts)
    n = F.sum("n_true").cast("double")
    s = c.agg(
        n.alias("__n"), F.sum("tp").cast("double").alias("__tp"),
        F.sum(F.col("n_true") * F.col("precision")).alias("__wp"),
        F.sum(F.col("n_true") * F.col("recall")).alias("__wr"),
        F.sum(F.col("n_true") * F.col("f1")).alias("__wf"),
        F.sum(F.col("n_true").cast("double") * F.col("n_pred")).alias("__tp_sum"),
        F.sum(F.col("n_pred").cast("double") * F.col("n_pred")).alias("__pp"),
        F.sum(F.col("n_true").cast("double") * F.col("n_true")).alias("__tt"))
    N = F.col("__n")
    kappa_den = N - F.try_divide(F.col("__tp_sum"), N)
    cov_tp = F.col("__tp") * N - F.col("__tp_sum")
    cov_pp = N * N - F.col("__pp")
    cov_tt = N * N - F.col("__tt")
    return s.select(
        F.try_divide(F.col("__tp"), N).alias("accuracy"),
        F.try_divide(F.col("__wp"), N).alias("precision"),
        F.try_divide(F.col("__wr"), N).alias("recall"),
        F.try_divide(F.col("__wf"), N).alias("f1_score"),
        F.when(kappa_den == 0, F.lit(None).cast("double"))
         .otherwise(1 - (N - F.col("__tp")) / kappa_den).alias("cohen_kappa"),
        F.when(cov_tt * cov_pp == 0, 0.0).otherwise(cov_tp / F.sqrt(cov_tt * cov_pp)).alias("matthews_corrcoef"))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """``(label, prediction, count)`` over the sorted union of classes, zero-filled (k x k rows)."""
    return _confusion(_pairs(df, label, pred))


def _confusion(pairs: DataFrame) -> DataFrame:
    classes = pairs.select(F.col("y").alias("c")).union(pairs.select(F.col("p").alias("c"))).distinct()
    # the k x k grid is the output itself: the class list is one array exploded twice (no join)
    grid = classes.agg(F.sort_array(F.collect_set("c")).alias("cs")) \
        .select(F.explode("cs").alias("label"), "cs").select("label", F.explode("cs").alias("prediction"))
    cells = pairs.select(F.col("y").alias("label"), F.col("p").alias("prediction"), "n")
    return grid.join(cells, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Per class precision / recall / F1 / support plus ``accuracy``, ``macro
    avg`` and ``weighted avg`` rows (``class`` as text)."""
    return _report(per_class_counts(df, label, pred))


def _report(counts: DataFrame) -> DataFrame:
    c = _prf(counts)
    rows = c.select(F.col("cls").cast("string").alias("class"), "precision", "recall", "f1",
                    F.col("n_true").alias("support"))
    tot = c.agg(F.sum("n_true").alias("__n"), F.sum("tp").alias("__tp"), F.count(F.lit(1)).alias("__k"),
                F.avg("precision").alias("__mp"), F.avg("recall").alias("__mr"), F.avg("f1").alias("__mf"),
                F.sum(F.col("precision") * F.col("n_true")).alias("__wp"),
                F.sum(F.col("recall") * F.col("n_true")).alias("__wr"),
                F.sum(F.col("f1") * F.col("n_true")).alias("__wf"))
    acc = tot.select(F.lit("accuracy").alias("class"), F.try_divide("__tp", "__n").alias("precision"),
                     F.try_divide("__tp", "__n").alias("recall"), F.try_divide("__tp", "__n").alias("f1"),
                     F.col("__n").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("class"), F.col("__mp").alias("precision"),
                       F.col("__mr").alias("recall"), F.col("__mf").alias("f1"), F.col("__n").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("class"), F.try_divide("__wp", "__n").alias("precision"),
                          F.try_divide("__wr", "__n").alias("recall"), F.try_divide("__wf", "__n").alias("f1"),
                          F.col("__n").alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


def log_loss(df: DataFrame, label: str = "label", probability: str = "probability",
             eps: float = EPS) -> DataFrame:
    """Mean negative log probability of the true class; probabilities are
    clipped to [eps, 1-eps] and renormalised per row.  ``label`` is the class
    index into the ``probability`` array (for a binary score pass ``[1-s, s]``)."""
    return df.agg(F.avg(_loss(label, probability, eps)).alias("log_loss"))


def _loss(label: str, probability: str, eps: float = EPS) -> Column:
    """Negative log probability of a row's true class."""
    clipped = F.transform(q(probability), lambda x: F.least(F.greatest(x, F.lit(eps)), F.lit(1 - eps)))
    tot = F.aggregate(clipped, F.lit(0.0), lambda a, x: a + x)
    return -F.log(F.element_at(clipped, q(label).cast("int") + 1) / tot)


# --------------------------------------------------------------------- AUC
def _score_table(df: DataFrame, positive: Column, score: Column, group: Column | None = None) -> DataFrame:
    keys = [group.alias("grp")] if group is not None else []
    return df.groupBy(*keys, score.cast("double").alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def _auc_from_table(t: DataFrame, grouped: bool) -> DataFrame:
    part = ["grp"] if grouped else []
    cs = ordered.cumulative_sum(t, ["neg"], ["score"], part)
    contrib = F.col("pos") * (F.col("cum_neg") - F.col("neg") + 0.5 * F.col("neg"))
    keys = [F.col("grp")] if grouped else []
    agg = cs.groupBy(*keys).agg(F.sum(contrib).alias("__u"), F.sum("pos").alias("__p"),
                                F.sum("neg").alias("__q"))
    return agg.select(*keys, F.try_divide(F.col("__u"), F.col("__p") * F.col("__q")).alias("roc_auc"),
                      F.col("__p").alias("n_pos"), F.col("__q").alias("n_neg"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """Binary ROC AUC = Mann-Whitney U with mid-ranks for tied scores."""
    t = _score_table(df, q(label) == F.lit(positive), q(score))
    return _auc_from_table(t, False).select("roc_auc")


def roc_auc_ovr(df: DataFrame, label: str = "label", probability: str = "probability",
                n_classes: int | None = None) -> DataFrame:
    """One-vs-rest ROC AUC per class, averaged with class prevalence weights.
    Each row is exploded to one (class, score) row per class (k bounded)."""
    return _weighted_auc(_auc_from_table(_class_scores(df, label, probability), True))


def _class_scores(df: DataFrame, label: str, probability: str) -> DataFrame:
    """Positives and negatives per (class, score) of a probability array."""
    exploded = df.select(q(label).cast("int").alias("__y"), F.posexplode(q(probability)).alias("__c", "__s"))
    return _score_table(exploded, F.col("__y") == F.col("__c"), F.col("__s"), F.col("__c"))


def _weighted_auc(per: DataFrame) -> DataFrame:
    return per.agg(F.when(F.count_if(F.col("roc_auc").isNull()) == 0, F.try_divide(
        F.sum(F.col("roc_auc") * F.col("n_pos")), F.sum("n_pos"))).alias("roc_auc"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", positive=1,
              drop_intermediate: bool = True) -> DataFrame:
    """ROC points ``(threshold, fpr, tpr)`` at decreasing distinct scores, led by
    ``(+inf, 0, 0)``; collinear interior points dropped like the plotting
    helper does (second differences of both counts zero)."""
    t = _score_table(df, q(label) == F.lit(positive), q(score), F.lit(positive))
    return roc_points(t, drop_intermediate).drop("class")


def roc_points(t: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """``(class, threshold, fpr, tpr)`` of every class of a ``(grp, score, pos, neg)`` table, as in ``roc_curve``."""
    t = t.withColumn("__ns", -F.col("score"))
    cs = ordered.cumulative_sum(t, ["pos", "neg"], ["__ns"], ["grp"])      # descending score
    tot = t.groupBy("grp").agg(F.sum("pos").alias("__P"), F.sum("neg").alias("__N"))
    pts = cs.select("grp", "score", F.col("cum_pos").alias("tps"), F.col("cum_neg").alias("fps"), "__ns")
    if drop_intermediate:
        nb = ordered.with_neighbour_rows(pts, ["__ns"], ["grp"], columns=["tps", "fps"])
        d2f = F.col("__next_row.fps") - 2 * F.col("fps") + F.col("__prev_row.fps")
        d2t = F.col("__next_row.tps") - 2 * F.col("tps") + F.col("__prev_row.tps")
        keep = F.col("__prev_row").isNull() | F.col("__next_row").isNull() | (d2f != 0) | (d2t != 0)
        pts = nb.where(keep).select("grp", "score", "tps", "fps")
    first = tot.select("grp", F.lit(float("inf")).alias("score"), F.lit(0).cast("bigint").alias("tps"),
                       F.lit(0).cast("bigint").alias("fps"))
    allp = pts.select("grp", "score", "tps", "fps").unionByName(first).join(F.broadcast(tot), "grp")   # one row per class
    return allp.select(F.col("grp").alias("class"), F.col("score").alias("threshold"),
                       F.try_divide("fps", "__N").alias("fpr"), F.try_divide("tps", "__P").alias("tpr"))


def pr_curve(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """Precision-recall points ``(threshold, precision, recall)`` for every
    distinct score down to the first threshold reaching full recall, plus
    the closing ``(null, 1, 0)`` point."""
    t = _score_table(df, q(label) == F.lit(positive), q(score)).withColumn("__ns", -F.col("score"))
    cs = ordered.cumulative_sum(t, ["pos", "neg"], ["__ns"])
    tot = t.agg(F.sum("pos").alias("__P"))
    j = attach_one_row(cs, tot)
    # keep thresholds up to (and including) the highest one where tps == P
    full = j.where(F.col("cum_pos") == F.col("__P")).agg(F.max("score").alias("__stop"))
    k = attach_one_row(j, full).where(F.col("score") >= F.col("__stop"))
    pts = k.select(F.col("score").alias("threshold"),
                   F.when(F.col("cum_pos") + F.col("cum_neg") > 0,
                          F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).otherwise(0.0).alias("precision"),
                   F.try_divide("cum_pos", "__P").alias("recall"))
    last = tot.select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                      F.lit(0.0).alias("recall"))
    return pts.unionByName(last)


# --------------------------------------------------------------------- one evaluation
@dataclass
class ClassificationEvaluation:
    """Everything about one model's predictions (L20); ``cv`` and ``importances`` are there if asked for."""
    metrics: DataFrame                        # one row: accuracy ... matthews_corrcoef, roc_auc, log_loss
    confusion: DataFrame                      # label, prediction, count
    report: DataFrame                         # class, precision, recall, f1, support
    roc: DataFrame | None = None              # class, threshold, fpr, tpr
    cv: DataFrame | None = None               # fold, score
    importances: DataFrame | None = None      # feature, importance

    def long(self) -> DataFrame:
        """All parts as ``(section, item, position, value)`` rows."""
        names = self.metrics.columns
        parts = [self.metrics.select(F.inline(F.array(*[F.struct(F.lit("metric").alias("section"), F.lit(c).alias("item"),
                                                                 F.lit("").alias("position"), q(c).cast("double").alias("value"))
                                                        for c in names])))]
        parts.append(self.confusion.select(F.lit("confusion").alias("section"), F.col("label").cast("string").alias("item"),
                                           F.col("prediction").cast("string").alias("position"), F.col("count").cast("double").alias("value")))
        kinds = ("precision", "recall", "f1", "support")
        parts.append(self.report.select(F.inline(F.array(*[F.struct(F.lit("report").alias("section"), F.col("class").alias("item"),
                                                                    F.lit(k).alias("position"), F.col(k).cast("double").alias("value"))
                                                           for k in kinds]))))
        if self.roc is not None:
            at = F.format_string("%.6f", "threshold")
            parts.append(self.roc.select(F.inline(F.array(*[F.struct(
                F.lit("roc_" + k).alias("section"), F.col("class").cast("string").alias("item"), at.alias("position"),
                F.col(k).alias("value")) for k in ("fpr", "tpr")]))))
        if self.cv is not None:
            parts.append(self.cv.select(F.lit("cv").alias("section"), F.lit("fold").alias("item"),
                                        F.col("fold").cast("string").alias("position"), F.col("score").alias("value")))
        if self.importances is not None:
            parts.append(self.importances.select(F.lit("importance").alias("section"), F.col("feature").alias("item"),
                                                 F.lit("").alias("position"), F.col("importance").alias("value")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def evaluate_classification(df: DataFrame, label: str = "label", pred: str = "prediction",
                            probability: str | None = "probability", curves: bool = True) -> ClassificationEvaluation:
    """Metrics, matrix, report and per-class ROC points of predictions from two passes over them.

    One pass gives counts and summed losses per (label, prediction), the other one positives and negatives per
    (class, score); everything else reads these two checkpointed tables.  AUC is that of class 1 for two classes and
    one-vs-rest, weighted by prevalence, for more; without ``probability`` AUC, loss and points are left out.
    """
    scored = probability is not None and probability in df.columns
    pairs = cut_lineage(df.groupBy(q(label).alias("y"), q(pred).alias("p")).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(_loss(label, probability)) if scored else F.lit(None).cast("double")).alias("loss")))
    counts = _class_counts(pairs)
    metrics = _metrics(counts)
    if not scored:
        none = F.lit(None).cast("double")
        return ClassificationEvaluation(metrics.select("*", none.alias("roc_auc"), none.alias("log_loss")), _confusion(pairs),
                                        _report(counts))
    table = cut_lineage(_class_scores(df, label, probability))
    per = cut_lineage(_auc_from_table(table, True))                  # one row per class
    auc = per.where("grp = 1").agg(F.max("roc_auc").alias("roc_auc")) if per.count() == 2 else _weighted_auc(per)
    loss = pairs.agg(F.try_divide(F.sum("loss"), F.sum("n")).alias("log_loss"))
    return ClassificationEvaluation(attach_one_row(attach_one_row(metrics, auc), loss), _confusion(pairs), _report(counts),
                                    roc_points(table) if curves else None)


# --------------------------------------------------------------------- regression
def regression_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """One row: r2 (1 on a perfect constant fit, 0 on an imperfect one), mse,
    rmse, mae, mape in % over non-zero labels, and the count of zero labels."""
    y, p = q(label).cast("double"), q(pred).cast("double")
    s = df.agg(F.count(F.lit(1)).alias("__n"), F.avg(y).alias("__ym"),
               F.sum((y - p) * (y - p)).alias("__ssr"), F.avg(F.abs(y - p)).alias("mae"),
               F.avg(F.when(y != 0, F.abs((y - p) / y))).alias("__ape"),
               F.count_if(y == 0).alias("n_zero_labels"))
    sst = attach_one_row(df, s.select("__ym")).agg(
        F.sum((y - F.col("__ym")) * (y - F.col("__ym"))).alias("__sst"))
    j = attach_one_row(s, sst)
    r2 = (F.when(F.col("__sst") == 0, F.when(F.col("__ssr") == 0, 1.0).otherwise(0.0))
          .otherwise(1 - F.col("__ssr") / F.col("__sst")))
    return j.select(r2.alias("r2_score"), (F.col("__ssr") / F.col("__n")).alias("mse"),
                    F.sqrt(F.col("__ssr") / F.col("__n")).alias("rmse"), "mae",
                    (F.col("__ape") * 100).alias("mape"), "n_zero_labels")


def residuals(df: DataFrame, label: str = "label", pred: str = "prediction",
              keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[q(c) for c in keep], q(label), q(pred),
                     (q(label).cast("double") - q(pred).cast("double")).alias("residual"))


# --------------------------------------------------------------------- comparison
def compare_models(results: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One row per model (``position`` keeps input order); metrics a model
    does not have are null."""
    out = None
    for i, (name, m) in enumerate(results):
        row = m.select(F.lit(name).alias("model"), F.lit(i).alias("position"), "*")
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out


def best_model(comparison: DataFrame, metric: str = "auto") -> DataFrame:
    """The best model by ``metric`` (auto: f1_score, else r2_score); lower is
    better for error metrics; nulls are skipped; the first model wins ties."""
    if metric == "auto":
        metric = "f1_score" if "f1_score" in comparison.columns else "r2_score"
    m = q(metric)
    best = comparison.where(m.isNotNull()).select("model", "position", m.cast("double").alias("value"))
    key = F.struct(*(([F.col("value")] if metric in LOWER_IS_BETTER else [-F.col("value")]) + [F.col("position")]))
    return best.agg(F.min(F.struct(key.alias("k"), F.col("model"), F.col("value"))).alias("b")).select(
        F.lit(metric).alias("metric"), F.col("b.model").alias("model"), F.col("b.value").alias("value"))


def comparison_long(comparison: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Chart data: ``(model, metric, value)`` for the numeric metrics present (B11):
    ``'N/A'`` and other non-numbers become null under ``try_cast`` (no ANSI
    error) and are dropped."""
    present = [m for m in metrics if m in comparison.columns]
    structs = [F.struct(F.lit(m).alias("metric"), q(m).try_cast("double").alias("value")) for m in present]
    return comparison.select("model", F.inline(F.array(*structs))).where(F.col("value").isNotNull())


CLASSIFICATION_CHART = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]
REGRESSION_CHART = ["r2_score", "mse", "rmse", "mae"]


def top_k(df: DataFrame, by: str, n: int, ascending: bool = False,
          tie_cols: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows ranked first by ``by`` (ties by ``tie_cols``).

    ``orderBy(...).limit(n)`` plans as a take-ordered: every partition keeps
    its own best ``n`` rows and only those reach the final merge, so the
    work is one scan and the driver / last task see at most
    ``n * partitions`` rows, whatever the table size."""
    key = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    return df.orderBy(key, *[F.asc(c) for c in tie_cols]).limit(n)
