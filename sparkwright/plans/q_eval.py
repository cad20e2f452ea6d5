"""Registered evaluation queries (L) with SQL oracles.

No model is needed to check the metric operators: predictions, scores and
class probabilities are fixed rules over ``lineitem`` that both engines
evaluate from the same expression text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwright.operators import evaluate as EV
from sparkwright.operators import profile as P
from sparkwright.plans.registry import register
from sparkwright.plans.tables import round_doubles, table
from sparkwright.functions.columns import attach_one_row

# Rule-based predictions (fixed expressions shared with the oracle).
BIN = {
    "label": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    "score": "l_discount * 10",
    "prediction": "CASE WHEN l_discount * 10 >= 0.5 THEN 1 ELSE 0 END",
}
MC = {
    "label": "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END",
    "prediction": "CASE WHEN l_quantity < 17 THEN 0 WHEN l_quantity < 34 THEN 1 ELSE 2 END",
    "p0": "(51 - l_quantity) / ((51 - l_quantity) + (26 - abs(l_quantity - 25.5)) + l_quantity)",
    "p1": "(26 - abs(l_quantity - 25.5)) / ((51 - l_quantity) + (26 - abs(l_quantity - 25.5)) + l_quantity)",
    "p2": "l_quantity / ((51 - l_quantity) + (26 - abs(l_quantity - 25.5)) + l_quantity)",
}
REG = {"label": "l_extendedprice", "prediction": "l_quantity * 1500 + l_tax * 1000"}
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
# Three rule "models" of the binary task for the comparison queries.
MODELS = [
    ("discount_50", "l_discount * 10", "CASE WHEN l_discount * 10 >= 0.5 THEN 1 ELSE 0 END"),
    ("discount_30", "l_discount * 10", "CASE WHEN l_discount * 10 >= 0.3 THEN 1 ELSE 0 END"),
    ("tax_40", "l_tax * 12.5", "CASE WHEN l_tax >= 0.04 THEN 1 ELSE 0 END"),
]


def _frame(spark, d, spec, with_key=False):
    cols = [f"{e} AS {k}" for k, e in spec.items()]
    return table(spark, d, "lineitem").selectExpr(*(KEY if with_key else []), *cols)


def _src(spec, with_key=False):
    cols = ", ".join([*(KEY if with_key else []), *[f"{e} AS {k}" for k, e in spec.items()]])
    return f"(SELECT {cols} FROM lineitem)"


def _mc_prob(spark, d):
    df = _frame(spark, d, MC)
    return df.select("label", "prediction", F.array("p0", "p1", "p2").alias("probability"))


def r(x, digits=6):
    return f"round(CAST({x} AS DOUBLE), {digits})"


# ------------------------------------------------------------------ SQL pieces
def _cls_sql(src):
    """accuracy, weighted P/R/F1, kappa, MCC over a (label, prediction) source."""
    return (f"WITH b AS (SELECT label AS y, prediction AS p FROM {src}), "
            f"cls AS (SELECT y AS c FROM b UNION SELECT p FROM b), "
            f"st AS (SELECT c, CAST(count(*) FILTER (WHERE y = c AND p = c) AS DOUBLE) AS tp, "
            f"CAST(count(*) FILTER (WHERE y = c) AS DOUBLE) AS nt, CAST(count(*) FILTER (WHERE p = c) AS DOUBLE) AS np "
            f"FROM cls, b GROUP BY c), "
            f"pr AS (SELECT *, CASE WHEN np > 0 THEN tp / np ELSE 0.0 END AS pre, "
            f"CASE WHEN nt > 0 THEN tp / nt ELSE 0.0 END AS rec FROM st), "
            f"f AS (SELECT *, CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0.0 END AS f1 FROM pr), "
            f"a AS (SELECT sum(nt) AS n, sum(tp) AS tp, sum(nt * pre) AS wp, sum(nt * rec) AS wr, sum(nt * f1) AS wf, "
            f"sum(nt * np) AS tps, sum(np * np) AS pp, sum(nt * nt) AS tt FROM f) "
            f"SELECT {r('tp / n')} AS accuracy, {r('wp / n')} AS precision, {r('wr / n')} AS recall, "
            f"{r('wf / n')} AS f1_score, {r('CASE WHEN n - tps / n = 0 THEN NULL ELSE 1 - (n - tp) / (n - tps / n) END')} "
            f"AS cohen_kappa, {r('CASE WHEN (n * n - tt) * (n * n - pp) = 0 THEN 0.0 ELSE (tp * n - tps) / sqrt((n * n - tt) * (n * n - pp)) END')} "
            f"AS matthews_corrcoef FROM a")


def _auc_sql(src):
    return (f"WITH t AS (SELECT CAST(score AS DOUBLE) AS score, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS pos, "
            f"CAST(count(*) FILTER (WHERE label <> 1) AS DOUBLE) AS neg FROM {src} GROUP BY 1), "
            f"c AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM t) "
            f"SELECT {r('sum(pos * (cn - neg + 0.5 * neg)) / (sum(pos) * sum(neg))')} AS roc_auc FROM c")


def _ovr_sql():
    src = _src(MC)
    ex = " UNION ALL ".join(f"SELECT {k} AS c, CAST(label = {k} AS INTEGER) AS label, p{k} AS score FROM {src}"
                            for k in range(3))
    return (f"WITH e AS ({ex}), t AS (SELECT c, CAST(score AS DOUBLE) AS score, "
            f"CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS pos, "
            f"CAST(count(*) FILTER (WHERE label <> 1) AS DOUBLE) AS neg FROM e GROUP BY 1, 2), "
            f"cc AS (SELECT *, sum(neg) OVER (PARTITION BY c ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND "
            f"CURRENT ROW) AS cn FROM t), "
            f"per AS (SELECT c, sum(pos * (cn - neg + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc, sum(pos) AS np "
            f"FROM cc GROUP BY c) SELECT {r('sum(auc * np) / sum(np)')} AS roc_auc FROM per")


_EPS = repr(EV.EPS)
_ONE = repr(1 - EV.EPS)


def _logloss_sql():
    src = _src(MC)
    cl = [f"least(greatest({p}, {_EPS}), {_ONE})" for p in ("p0", "p1", "p2")]
    py = f"(CASE label WHEN 0 THEN {cl[0]} WHEN 1 THEN {cl[1]} ELSE {cl[2]} END)"
    return f"SELECT {r(f'-avg(ln({py} / ({cl[0]} + {cl[1]} + {cl[2]})))')} AS log_loss FROM {src}"


def _reg_sql(src):
    return (f"WITH s AS (SELECT CAST(label AS DOUBLE) AS y, CAST(prediction AS DOUBLE) AS p FROM {src}), "
            f"a AS (SELECT count(*) AS n, avg(y) AS ym, sum((y - p) * (y - p)) AS ssr, avg(abs(y - p)) AS mae, "
            f"avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) AS ape, count(*) FILTER (WHERE y = 0) AS nz FROM s), "
            f"t AS (SELECT sum((y - ym) * (y - ym)) AS sst FROM s, a) "
            f"SELECT {r('CASE WHEN sst = 0 THEN (CASE WHEN ssr = 0 THEN 1.0 ELSE 0.0 END) ELSE 1 - ssr / sst END')} AS r2_score, "
            f"{r('ssr / n', 2)} AS mse, {r('sqrt(ssr / n)')} AS rmse, {r('mae')} AS mae, {r('ape * 100')} AS mape, "
            f"nz AS n_zero_labels FROM a, t")


# ------------------------------------------------------------------ L1-L4
_CLS_MC = _cls_sql(_src(MC))


@register("metric_accuracy", f"SELECT accuracy FROM ({_CLS_MC})")
def q_metric_accuracy(spark, d):
    return round_doubles(EV.classification_metrics(_frame(spark, d, MC)).select("accuracy"))


@register("metric_weighted_prf", f"SELECT precision, recall, f1_score FROM ({_CLS_MC})")
def q_metric_weighted_prf(spark, d):
    return round_doubles(EV.classification_metrics(_frame(spark, d, MC)).select("precision", "recall", "f1_score"))


@register("metric_kappa", f"SELECT cohen_kappa FROM ({_CLS_MC})")
def q_metric_kappa(spark, d):
    return round_doubles(EV.classification_metrics(_frame(spark, d, MC)).select("cohen_kappa"))


@register("metric_mcc", f"SELECT matthews_corrcoef FROM ({_CLS_MC})")
def q_metric_mcc(spark, d):
    return round_doubles(EV.classification_metrics(_frame(spark, d, MC)).select("matthews_corrcoef"))


@register("metric_log_loss", _logloss_sql())
def q_metric_log_loss(spark, d):
    return round_doubles(EV.log_loss(_mc_prob(spark, d)))


# ------------------------------------------------------------------ L6 / L7
@register("confusion_matrix",
          f"WITH b AS (SELECT label AS y, prediction AS p FROM {_src(MC)}), cls AS (SELECT y AS c FROM b UNION "
          f"SELECT p FROM b) SELECT a.c AS label, o.c AS prediction, (SELECT count(*) FROM b WHERE y = a.c AND "
          f"p = o.c) AS count FROM cls a, cls o")
def q_confusion_matrix(spark, d):
    return EV.confusion_matrix(_frame(spark, d, MC))


def _report_sql(src):
    return (f"WITH b AS (SELECT label AS y, prediction AS p FROM {src}), "
            f"cls AS (SELECT y AS c FROM b UNION SELECT p FROM b), "
            f"st AS (SELECT c, CAST(count(*) FILTER (WHERE y = c AND p = c) AS DOUBLE) AS tp, "
            f"count(*) FILTER (WHERE y = c) AS nt, CAST(count(*) FILTER (WHERE p = c) AS DOUBLE) AS np "
            f"FROM cls, b GROUP BY c), "
            f"pr AS (SELECT *, CASE WHEN np > 0 THEN tp / np ELSE 0.0 END AS pre, "
            f"CASE WHEN nt > 0 THEN tp / nt ELSE 0.0 END AS rec FROM st), "
            f"f AS (SELECT *, CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0.0 END AS f1 FROM pr), "
            f"a AS (SELECT sum(nt) AS n, sum(tp) AS tp, avg(pre) AS mp, avg(rec) AS mr, avg(f1) AS mf, "
            f"sum(pre * nt) AS wp, sum(rec * nt) AS wr, sum(f1 * nt) AS wf FROM f) "
            f"SELECT CAST(c AS VARCHAR) AS class, {r('pre')} AS precision, {r('rec')} AS recall, {r('f1')} AS f1, "
            f"nt AS support FROM f UNION ALL "
            f"SELECT 'accuracy', {r('tp / n')}, {r('tp / n')}, {r('tp / n')}, CAST(n AS BIGINT) FROM a UNION ALL "
            f"SELECT 'macro avg', {r('mp')}, {r('mr')}, {r('mf')}, CAST(n AS BIGINT) FROM a UNION ALL "
            f"SELECT 'weighted avg', {r('wp / n')}, {r('wr / n')}, {r('wf / n')}, CAST(n AS BIGINT) FROM a")


@register("classification_report", _report_sql(_src(MC)))
def q_classification_report(spark, d):
    return round_doubles(EV.classification_report(_frame(spark, d, MC)))


# ------------------------------------------------------------------ L8-L11
@register("roc_auc", _auc_sql(_src(BIN)))
def q_roc_auc(spark, d):
    return round_doubles(EV.roc_auc(_frame(spark, d, BIN)))


@register("roc_auc_ovr", _ovr_sql())
def q_roc_auc_ovr(spark, d):
    return round_doubles(EV.roc_auc_ovr(_mc_prob(spark, d)))


_ROC_SQL = (
    f"WITH t AS (SELECT CAST(score AS DOUBLE) AS score, count(*) FILTER (WHERE label = 1) AS pos, "
    f"count(*) FILTER (WHERE label <> 1) AS neg FROM {_src(BIN)} GROUP BY 1), "
    f"c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps, "
    f"sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps FROM t), "
    f"n AS (SELECT *, lag(tps) OVER (ORDER BY score DESC) AS tp0, lead(tps) OVER (ORDER BY score DESC) AS tp1, "
    f"lag(fps) OVER (ORDER BY score DESC) AS fp0, lead(fps) OVER (ORDER BY score DESC) AS fp1 FROM c), "
    f"k AS (SELECT score, tps, fps FROM n WHERE tp0 IS NULL OR tp1 IS NULL OR tp1 - 2 * tps + tp0 <> 0 OR "
    f"fp1 - 2 * fps + fp0 <> 0 UNION ALL SELECT 'inf'::DOUBLE, 0, 0), "
    f"tot AS (SELECT CAST(sum(pos) AS DOUBLE) AS P, CAST(sum(neg) AS DOUBLE) AS N FROM t) "
    f"SELECT round(score, 6) AS threshold, {r('fps / N')} AS fpr, {r('tps / P')} AS tpr FROM k, tot")


@register("roc_curve", _ROC_SQL)
def q_roc_curve(spark, d):
    return round_doubles(EV.roc_curve(_frame(spark, d, BIN)))


_PR_SQL = (
    f"WITH t AS (SELECT CAST(score AS DOUBLE) AS score, count(*) FILTER (WHERE label = 1) AS pos, "
    f"count(*) FILTER (WHERE label <> 1) AS neg FROM {_src(BIN)} GROUP BY 1), "
    f"c AS (SELECT score, CAST(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
    f"AS DOUBLE) AS tps, CAST(sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
    f"AS DOUBLE) AS fps FROM t), tot AS (SELECT CAST(sum(pos) AS DOUBLE) AS P FROM t), "
    f"stop AS (SELECT max(score) AS s FROM c, tot WHERE tps = P) "
    f"SELECT round(score, 6) AS threshold, {r('CASE WHEN tps + fps > 0 THEN tps / (tps + fps) ELSE 0.0 END')} AS "
    f"precision, {r('tps / P')} AS recall FROM c, tot, stop WHERE score >= s "
    f"UNION ALL SELECT CAST(NULL AS DOUBLE), 1.0, 0.0")


@register("pr_curve", _PR_SQL)
def q_pr_curve(spark, d):
    return round_doubles(EV.pr_curve(_frame(spark, d, BIN)))


# ------------------------------------------------------------------ L14-L17
_REG = _reg_sql(_src(REG))


@register("metric_r2", f"SELECT r2_score FROM ({_REG})")
def q_metric_r2(spark, d):
    return round_doubles(EV.regression_metrics(_frame(spark, d, REG)).select("r2_score"))


@register("metric_mse_rmse_mae", f"SELECT mse, rmse, mae FROM ({_REG})")
def q_metric_mse_rmse_mae(spark, d):
    return round_doubles(EV.regression_metrics(_frame(spark, d, REG)).select("mse", "rmse", "mae"),
                         per_column={"mse": 2})


@register("metric_mape", f"SELECT mape, n_zero_labels FROM ({_REG})")
def q_metric_mape(spark, d):
    return round_doubles(EV.regression_metrics(_frame(spark, d, REG)).select("mape", "n_zero_labels"))


@register("evaluate_regression", _REG)
def q_evaluate_regression(spark, d):
    return round_doubles(EV.regression_metrics(_frame(spark, d, REG)), per_column={"mse": 2})


@register("residuals", f"SELECT {', '.join(KEY)}, {r('label')} AS label, {r('prediction')} AS prediction, "
          f"{r('CAST(label AS DOUBLE) - CAST(prediction AS DOUBLE)')} AS residual FROM {_src(REG, True)}")
def q_residuals(spark, d):
    return round_doubles(EV.residuals(_frame(spark, d, REG, True), keep=KEY))


def _residual_hist_sql():
    from sparkwright.plans.q_profile import _hist_sql
    src = f"(SELECT CAST(label AS DOUBLE) - CAST(prediction AS DOUBLE) AS residual FROM {_src(REG)})"
    return _hist_sql(src, "residual", 30)


@register("residual_histogram", _residual_hist_sql())
def q_residual_histogram(spark, d):
    res = EV.residuals(_frame(spark, d, REG))
    return round_doubles(P.histogram(res, "residual", 30))


# ------------------------------------------------------------------ L18-L22
def _model_src(score, pred):
    return f"(SELECT {BIN['label']} AS label, {score} AS score, {pred} AS prediction FROM lineitem)"


def _compare_sql():
    parts = []
    for i, (name, score, pred) in enumerate(MODELS):
        src = _model_src(score, pred)
        parts.append(f"SELECT '{name}' AS model, {i} AS position, m.*, a.roc_auc FROM ({_cls_sql(src)}) m, "
                     f"({_auc_sql(src)}) a")
    return " UNION ALL ".join(parts)


def _compare_frame(spark, d):
    res = []
    for name, score, pred in MODELS:
        df = table(spark, d, "lineitem").selectExpr(f"{BIN['label']} AS label", f"{score} AS score",
                                                    f"{pred} AS prediction")
        m = attach_one_row(EV.classification_metrics(df), EV.roc_auc(df))
        res.append((name, m))
    return EV.compare_models(res)


@register("compare_models", _compare_sql())
def q_compare_models(spark, d):
    return round_doubles(_compare_frame(spark, d))


@register("best_model",
          f"SELECT 'f1_score' AS metric, model, f1_score AS value FROM ({_compare_sql()}) "
          f"ORDER BY f1_score DESC, position LIMIT 1")
def q_best_model(spark, d):
    return EV.best_model(round_doubles(_compare_frame(spark, d)))


@register("compare_chart", " UNION ALL ".join(
    f"SELECT model, '{m}' AS metric, {m} AS value FROM ({_compare_sql()})" for m in EV.CLASSIFICATION_CHART))
def q_compare_chart(spark, d):
    return EV.comparison_long(round_doubles(_compare_frame(spark, d)), EV.CLASSIFICATION_CHART)


@register("evaluate_classification",
          f"SELECT m.*, o.roc_auc, l.log_loss FROM ({_CLS_MC}) m, ({_ovr_sql()}) o, ({_logloss_sql()}) l")
def q_evaluate_classification(spark, d):
    df = _mc_prob(spark, d)
    out = attach_one_row(attach_one_row(EV.classification_metrics(df), EV.roc_auc_ovr(df)), EV.log_loss(df))
    return round_doubles(out)


def _roc_per_class_sql():
    src = _src(MC)
    ex = " UNION ALL ".join(f"SELECT {k} AS c, CAST(label = {k} AS INTEGER) AS label, CAST(p{k} AS DOUBLE) AS score FROM {src}"
                            for k in range(3))
    w = "PARTITION BY c ORDER BY score DESC"
    return (f"(WITH t AS (SELECT c, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg "
            f"FROM ({ex}) GROUP BY 1, 2), "
            f"s AS (SELECT c, score, sum(pos) OVER ({w} ROWS UNBOUNDED PRECEDING) AS tps, sum(neg) OVER ({w} ROWS UNBOUNDED "
            f"PRECEDING) AS fps FROM t), "
            f"n AS (SELECT *, lag(tps) OVER ({w}) AS tp0, lead(tps) OVER ({w}) AS tp1, lag(fps) OVER ({w}) AS fp0, "
            f"lead(fps) OVER ({w}) AS fp1 FROM s), "
            f"k AS (SELECT c, score, tps, fps FROM n WHERE tp0 IS NULL OR tp1 IS NULL OR tp1 - 2 * tps + tp0 <> 0 OR "
            f"fp1 - 2 * fps + fp0 <> 0 UNION ALL SELECT DISTINCT c, 'inf'::DOUBLE, 0, 0 FROM t), "
            f"tot AS (SELECT c, CAST(sum(pos) AS DOUBLE) AS P, CAST(sum(neg) AS DOUBLE) AS N FROM t GROUP BY c) "
            f"SELECT CAST(c AS VARCHAR) AS item, CASE WHEN isinf(score) THEN 'Infinity' ELSE printf('%.6f', score) END AS position, "
            f"fps / N AS fpr, tps / P AS tpr FROM k JOIN tot USING (c))")


_MC_METRICS = ["accuracy", "precision", "recall", "f1_score", "cohen_kappa", "matthews_corrcoef", "roc_auc", "log_loss"]
_FULL_SQL = " UNION ALL ".join([
    *[f"SELECT 'metric' AS section, '{m}' AS item, '' AS position, CAST({m} AS DOUBLE) AS value FROM "
      f"(SELECT m.*, o.roc_auc, l.log_loss FROM ({_CLS_MC}) m, ({_ovr_sql()}) o, ({_logloss_sql()}) l)" for m in _MC_METRICS],
    f"SELECT 'confusion', CAST(a.c AS VARCHAR), CAST(o.c AS VARCHAR), CAST((SELECT count(*) FROM {_src(MC)} WHERE label = a.c "
    f"AND prediction = o.c) AS DOUBLE) FROM (VALUES (0), (1), (2)) a(c), (VALUES (0), (1), (2)) o(c)",
    *[f"SELECT 'report', class, '{k}', CAST({k} AS DOUBLE) FROM ({_report_sql(_src(MC))})" for k in ("precision", "recall", "f1", "support")],
    *[f"SELECT 'roc_{k}', item, position, {r(k)} FROM {_roc_per_class_sql()}" for k in ("fpr", "tpr")]])


@register("evaluate_full", _FULL_SQL)
def q_evaluate_full(spark, d):
    """Metrics, matrix, report and the ROC points of every class from one evaluation."""
    return round_doubles(EV.evaluate_classification(_mc_prob(spark, d)).long())


# ===================================================================== K25 / top-k report
_TOPK_KEY = [*KEY, "l_extendedprice"]      # unique row key of lineitem


@register("topk", "SELECT " + ", ".join(_TOPK_KEY) + ", " + r("l_discount * 10") + " AS score "
          "FROM lineitem ORDER BY l_discount * 10 DESC, " + ", ".join(_TOPK_KEY) + " LIMIT 10")
def q_topk(spark, d):
    """Top-10 rows of a scored table (the rule score of the binary task),
    ties broken by the unique row key."""
    df = table(spark, d, "lineitem").select(*_TOPK_KEY, (F.col("l_discount") * 10).alias("score"))
    return round_doubles(EV.top_k(df, "score", 10, tie_cols=_TOPK_KEY))
