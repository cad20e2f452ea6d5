"""Registered preparation-flow queries (J1-J6) with SQL oracles."""

from __future__ import annotations

from sparkwright.plans import prep as PR
from sparkwright.plans.q_split import _quota_sql
from sparkwright.plans.registry import register
from sparkwright.plans.tables import (events_nulls, events_nulls_sql, orders_nulls, orders_nulls_sql, round_doubles,
                                      table)

OR_F = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
ORS = orders_nulls_sql(OR_F)
_HO = "md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR)))"
_HE = "md5(concat_ws('|', '42', CAST(event_id AS VARCHAR)))"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _dict(src, col):
    return (f"(SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM "
            f"(SELECT DISTINCT coalesce(CAST({col} AS VARCHAR), 'nan') AS v FROM {src}))")


def _std(cols, src):
    return ", ".join(f"avg({c}) AS a_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS b_{c}"
                     for c in cols) + f" FROM {src} WHERE split = 'train'"


def _strat_split(src, h):
    """Stratified split when every class can be split, else random (over src with `label`)."""
    return (f"(SELECT l.*, CASE WHEN (SELECT min(n_c) >= 2 AND ceil(CAST(sum(n_c) AS DOUBLE) * 0.2) >= count(*) "
            f"AND sum(n_c) - ceil(CAST(sum(n_c) AS DOUBLE) * 0.2) >= count(*) FROM (SELECT count(*) AS n_c FROM {src} "
            f"GROUP BY label)) THEN (CASE WHEN row_number() OVER (PARTITION BY l.label ORDER BY {h}) <= qt.quota "
            f"THEN 'test' ELSE 'train' END) ELSE (CASE WHEN row_number() OVER (ORDER BY {h}) <= "
            f"ceil(CAST(count(*) OVER () AS DOUBLE) * 0.2) THEN 'test' ELSE 'train' END) END AS split "
            f"FROM {src} l JOIN {_quota_sql(src, 'label')} qt ON l.label = qt.label)")


# ------------------------------------------------------------------ J1
_QUICK_FEATS = ["o_custkey", "o_totalprice", "o_orderpriority"]
_NOTNULL = " AND ".join(f"{c} IS NOT NULL" for c in _QUICK_FEATS)
_MISS = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in _QUICK_FEATS)

_QUICK_SQL = (
    f"WITH r AS (SELECT {_MISS} AS nm, CAST({_MISS} AS DOUBLE) / (count(*) * 3) AS ratio FROM {ORS}), "
    f"strat AS (SELECT CASE WHEN nm = 0 THEN 'none' WHEN ratio < 0.05 THEN 'drop' WHEN ratio < 0.30 THEN 'knn' "
    f"ELSE 'mean_mode' END AS s FROM r), "
    f"b AS (SELECT o.* FROM {ORS} o, strat WHERE strat.s <> 'drop' OR ({_NOTNULL})), "
    f"l AS (SELECT b.*, CAST(d.code AS DOUBLE) AS label FROM b JOIN {_dict('b', 'o_orderstatus')} d "
    f"ON coalesce(b.o_orderstatus, 'nan') = d.v), "
    f"s AS {_strat_split('l', _HO)}, "
    f"mm AS (SELECT avg(o_custkey) AS m_c, avg(o_totalprice) AS m_t, (SELECT v FROM (SELECT o_orderpriority AS v, "
    f"count(*) AS n FROM s WHERE split = 'train' AND o_orderpriority IS NOT NULL GROUP BY 1) ORDER BY n DESC, v "
    f"LIMIT 1) AS m_p FROM s WHERE split = 'train'), "
    f"f AS (SELECT o_orderkey, CASE WHEN strat.s = 'mean_mode' THEN coalesce(CAST(o_custkey AS DOUBLE), m_c) "
    f"ELSE o_custkey END AS o_custkey, CASE WHEN strat.s = 'mean_mode' THEN coalesce(o_totalprice, m_t) "
    f"ELSE o_totalprice END AS o_totalprice, CASE WHEN strat.s = 'mean_mode' THEN coalesce(o_orderpriority, m_p) "
    f"ELSE o_orderpriority END AS o_orderpriority, label, split FROM s, strat, mm), "
    f"st AS (SELECT {_std(['o_custkey', 'o_totalprice'], 'f')}) "
    f"SELECT o_orderkey, round((o_custkey - a_o_custkey) / b_o_custkey, 6) AS o_custkey, "
    f"round((o_totalprice - a_o_totalprice) / b_o_totalprice, 6) AS o_totalprice, "
    + ", ".join(f"CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END AS \"o_orderpriority_{v}\"" for v in PRIORITIES)
    + ", label, split FROM f, st")


@register("prep_quick", _QUICK_SQL)
def q_prep_quick(spark, d):
    p = PR.prep_quick(orders_nulls(spark, d, OR_F), "o_orderstatus", ["o_orderkey"])
    return round_doubles(p.frame)


# ------------------------------------------------------------------ J2
_MIN_SQL = (
    f"WITH l AS (SELECT o.*, CAST(d.code AS DOUBLE) AS label FROM {ORS} o JOIN {_dict(ORS, 'o_orderstatus')} d "
    f"ON coalesce(o.o_orderstatus, 'nan') = d.v), s AS {_strat_split('l', _HO)}, "
    f"mm AS (SELECT avg(o_totalprice) AS m_t, (SELECT v FROM (SELECT o_orderpriority AS v, count(*) AS n FROM s "
    f"WHERE split = 'train' AND o_orderpriority IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS m_p "
    f"FROM s WHERE split = 'train'), "
    f"f AS (SELECT o_orderkey, o_custkey, coalesce(o_totalprice, m_t) AS o_totalprice, "
    f"coalesce(o_orderpriority, m_p) AS o_orderpriority, label, split FROM s, mm) "
    f"SELECT o_orderkey, CAST(o_custkey AS FLOAT) AS o_custkey, CAST(o_totalprice AS FLOAT) AS o_totalprice, "
    f"CAST(pd.code AS FLOAT) AS o_orderpriority, label, split FROM f JOIN {_dict('f', 'o_orderpriority')} pd "
    f"ON coalesce(f.o_orderpriority, 'nan') = pd.v")


@register("prep_minimal", _MIN_SQL)
def q_prep_minimal(spark, d):
    return PR.prep_minimal(orders_nulls(spark, d, OR_F), "o_orderstatus", ["o_orderkey"]).frame


# ------------------------------------------------------------------ J3
_RAW_SQL = (
    f"WITH l AS (SELECT o_orderkey, CAST(coalesce(CAST(o_custkey AS FLOAT), 0.0) AS FLOAT) AS o_custkey, "
    f"CAST(coalesce(CAST(o_totalprice AS FLOAT), 0.0) AS FLOAT) AS o_totalprice, CAST(d.code AS DOUBLE) AS label "
    f"FROM {ORS} o JOIN {_dict(ORS, 'o_orderpriority')} d ON coalesce(o.o_orderpriority, 'nan') = d.v) "
    f"SELECT *, CASE WHEN row_number() OVER (ORDER BY {_HO}) <= ceil(CAST(count(*) OVER () AS DOUBLE) * 0.2) "
    f"THEN 'test' ELSE 'train' END AS split FROM l")


@register("prep_raw", _RAW_SQL)
def q_prep_raw(spark, d):
    return PR.prep_raw(orders_nulls(spark, d, OR_F), "o_orderpriority", ["o_orderkey"]).frame


# ------------------------------------------------------------------ J4
EV_F = ["event_id", "user_id", "event_type", "value", "props"]
EVS = events_nulls_sql(EV_F)
CUSTOM_SPECS = {
    "value": PR.ColumnSpec(missing="median", outliers="clip", binning="equal_width", n_bins=5, scaling="log"),
    "user_id": PR.ColumnSpec(binning="equal_frequency", n_bins=4),
    "props": PR.ColumnSpec(text_processing=["remove_special_chars", "strip_whitespace"], encoding="frequency"),
}
_EW = " + ".join(f"CASE WHEN ew.lo + {i} * ((ew.hi - ew.lo) / 5) < value THEN 1 ELSE 0 END" for i in range(1, 5))
_FEATS = ["user_id", "value", "props", "value_binned", "user_id_binned"]
_CUSTOM_SQL = (
    f"WITH e AS (SELECT * FROM {EVS}), m AS (SELECT quantile_cont(value, 0.5) AS med FROM e), "
    f"e1 AS (SELECT event_id, user_id, event_type, CAST(coalesce(value, med) AS DOUBLE) AS value, props FROM e, m), "
    f"fb AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(value, 0.25) "
    f"AS q1, quantile_cont(value, 0.75) AS q3 FROM e1)), "
    f"e2 AS (SELECT event_id, user_id, event_type, CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END "
    f"AS value, props FROM e1, fb), "
    f"ew AS (SELECT min(value) AS lo, max(value) AS hi FROM e2), "
    f"e3 AS (SELECT e2.*, CASE WHEN value IS NULL THEN NULL ELSE CAST({_EW} AS INTEGER) END AS value_binned "
    f"FROM e2, ew), "
    f"e4 AS (SELECT event_id, user_id, event_type, CASE WHEN value > -1 THEN ln(1 + value) END AS value, props, "
    f"value_binned FROM e3), "
    f"uq AS (SELECT list_distinct(quantile_cont(user_id, [0.0, 0.25, 0.5, 0.75, 1.0])) AS edges FROM e4), "
    f"e5 AS (SELECT e4.*, CASE WHEN user_id IS NULL THEN NULL ELSE CAST(greatest(len(list_filter(edges, "
    f"lambda t: t < user_id)) - 1, 0) AS INTEGER) END AS user_id_binned FROM e4, uq), "
    f"e6 AS (SELECT e5.*, regexp_replace(regexp_replace(props, '[^a-zA-Z0-9\\s]', '', 'g'), '^\\s+|\\s+$', '', 'g') "
    f"AS p2 FROM e5), "
    f"fq AS (SELECT p2 AS v, CAST(count(*) AS DOUBLE) / (SELECT count(p2) FROM e6) AS freq FROM e6 "
    f"WHERE p2 IS NOT NULL GROUP BY p2), "
    f"e7 AS (SELECT event_id, coalesce(CAST(user_id AS DOUBLE), 0.0) AS user_id, coalesce(value, 0.0) AS value, "
    f"coalesce(fq.freq, 0.0) AS props, coalesce(CAST(value_binned AS DOUBLE), 0.0) AS value_binned, "
    f"coalesce(CAST(user_id_binned AS DOUBLE), 0.0) AS user_id_binned, event_type FROM e6 LEFT JOIN fq ON e6.p2 = fq.v), "
    f"e8 AS (SELECT e7.*, CAST(ld.code AS DOUBLE) AS label FROM e7 JOIN {_dict('e7', 'event_type')} ld "
    f"ON coalesce(e7.event_type, 'nan') = ld.v), "
    f"sp AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {_HE}) <= ceil(CAST(count(*) OVER () AS DOUBLE) * 0.2) "
    f"THEN 'test' ELSE 'train' END AS split FROM e8), "
    f"st AS (SELECT {_std(_FEATS, 'sp')}) "
    f"SELECT event_id, " + ", ".join(f"round((sp.{c} - a_{c}) / b_{c}, 6) AS {c}" for c in _FEATS)
    + ", label, split FROM sp, st")


@register("prep_custom", _CUSTOM_SQL)
def q_prep_custom(spark, d):
    p = PR.prep_custom(events_nulls(spark, d, EV_F), "event_type", ["event_id"], CUSTOM_SPECS, normalize=True, fit_on="all")
    return round_doubles(p.frame)


# ------------------------------------------------------------------ J5 / J6
@register("prep_report")
def q_prep_report(spark, d):
    """Step table of the quick flow (no SQL form: it describes the fitted plan)."""
    return PR.prep_quick(orders_nulls(spark, d, OR_F), "o_orderstatus", ["o_orderkey"]).report()


@register("prep_apply",
          _QUICK_SQL.replace("SELECT o_orderkey, round((o_custkey", "SELECT o_orderkey, round((o_custkey", 1))
def q_prep_apply(spark, d):
    """Fit the quick flow, then replay its recipe on the raw rows that
    survive the missing-value step: equals the flow's own output."""
    raw = orders_nulls(spark, d, OR_F)
    p = PR.prep_quick(raw, "o_orderstatus", ["o_orderkey"])
    kept = p.frame.select("o_orderkey", "split")
    replay = p.apply(raw.join(kept, "o_orderkey"))
    return round_doubles(replay.select(*p.frame.columns))


@register("stream_apply", "SELECT * EXCLUDE (split) FROM (" + _QUICK_SQL + ")")
def q_stream_apply(spark, d):
    """Fit the quick flow on the table, then replay its recipe on the same
    table read as a *stream* (file source -> stateless steps -> file sink)."""
    from sparkwright.streaming.apply import prepare_stream, read_stream, run_to_files
    from sparkwright.plans.tables import ORDERS_NULLS, _null_exprs
    raw = orders_nulls(spark, d, OR_F)
    p = PR.prep_quick(raw, "o_orderstatus", ["o_orderkey"])
    schema = spark.read.parquet(f"{d}/orders.parquet").schema
    stream = read_stream(spark, d, schema, file_glob="orders.parquet")
    out = prepare_stream(stream, p, require=["o_custkey", "o_totalprice", "o_orderpriority"],
                         pre=lambda s: s.selectExpr(*_null_exprs(OR_F, ORDERS_NULLS)))
    path = run_to_files(out)
    return round_doubles(spark.read.parquet(path))


# ------------------------------------------------------------------ statistics of train rows only
_EW_T = _EW.replace("value", "x.value")
_CUSTOM_TRAIN_SQL = (
    f"WITH e0 AS (SELECT * FROM {EVS}), "
    f"e AS (SELECT e0.*, CAST(ld.code AS DOUBLE) AS label, CASE WHEN row_number() OVER (ORDER BY {_HE}) <= "
    f"ceil(CAST(count(*) OVER () AS DOUBLE) * 0.2) THEN 'test' ELSE 'train' END AS split FROM e0 "
    f"JOIN {_dict('e0', 'event_type')} ld ON coalesce(e0.event_type, 'nan') = ld.v), "
    f"m AS (SELECT quantile_cont(value, 0.5) AS med FROM e WHERE split = 'train'), "
    f"e1 AS (SELECT e.* EXCLUDE (value), CAST(coalesce(value, med) AS DOUBLE) AS value FROM e, m), "
    f"fb AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(value, 0.25) AS q1, "
    f"quantile_cont(value, 0.75) AS q3 FROM e1 WHERE split = 'train')), "
    f"e2 AS (SELECT e1.* EXCLUDE (value), CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END AS value FROM e1, fb), "
    f"ew AS (SELECT min(value) AS lo, max(value) AS hi FROM e2 WHERE split = 'train'), "
    f"uq AS (SELECT list_distinct(quantile_cont(user_id, [0.0, 0.25, 0.5, 0.75, 1.0])) AS edges FROM e2 WHERE split = 'train'), "
    f"e3 AS (SELECT x.* EXCLUDE (value, props), CASE WHEN value IS NULL THEN NULL ELSE CAST({_EW_T} AS INTEGER) END AS value_binned, "
    f"CASE WHEN user_id IS NULL THEN NULL ELSE CAST(greatest(len(list_filter(edges, lambda t: t < user_id)) - 1, 0) AS INTEGER) END "
    f"AS user_id_binned, CASE WHEN value > -1 THEN ln(1 + value) END AS value, "
    f"regexp_replace(regexp_replace(props, '[^a-zA-Z0-9\\s]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS p2 FROM e2 x, ew, uq), "
    f"fq AS (SELECT p2 AS v, CAST(count(*) AS DOUBLE) / (SELECT count(p2) FROM e3 WHERE split = 'train') AS freq FROM e3 "
    f"WHERE p2 IS NOT NULL AND split = 'train' GROUP BY p2), "
    f"sp AS (SELECT event_id, coalesce(CAST(user_id AS DOUBLE), 0.0) AS user_id, coalesce(value, 0.0) AS value, "
    f"coalesce(fq.freq, 0.0) AS props, coalesce(CAST(value_binned AS DOUBLE), 0.0) AS value_binned, "
    f"coalesce(CAST(user_id_binned AS DOUBLE), 0.0) AS user_id_binned, label, split FROM e3 LEFT JOIN fq ON e3.p2 = fq.v), "
    f"st AS (SELECT {_std(_FEATS, 'sp')}) "
    f"SELECT event_id, " + ", ".join(f"round((sp.{c} - a_{c}) / b_{c}, 6) AS {c}" for c in _FEATS)
    + ", label, split FROM sp, st")


@register("prep_custom_train", _CUSTOM_TRAIN_SQL)
def q_prep_custom_train(spark, d):
    """The custom flow with every statistic taken from the train rows."""
    p = PR.prep_custom(events_nulls(spark, d, EV_F), "event_type", ["event_id"], CUSTOM_SPECS, normalize=True)
    return round_doubles(p.frame)


# ------------------------------------------------------------------ J5 with a k-NN step, on a batch and on a stream
_KNN_COLS = ["p_partkey", "p_type", "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size END AS p_size",
             "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice"]
_HP = "md5(concat_ws('|', '42', CAST(p_partkey AS VARCHAR)))"


def _neighbour_sql(target, other):
    """Mean of ``target`` over the five nearest train rows that have it, by the one other feature."""
    return (f"(SELECT qk, sum(v * take) / sum(take) AS imp FROM (SELECT qk, v, least(n, 5 - (cum - n)) AS take FROM (SELECT *, "
            f"sum(n) OVER (PARTITION BY qk ORDER BY d2, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM ("
            f"SELECT rr.qk, dd.v, dd.n, dd.t, 2.0 * ((rr.o - dd.o) * (rr.o - dd.o)) AS d2 FROM "
            f"(SELECT DISTINCT key AS qk, {other} AS o FROM k WHERE {target} IS NULL AND {other} IS NOT NULL) rr, "
            f"(SELECT {other} AS o, {target} AS v, key AS t, count(*) AS n FROM k WHERE split = 'train' AND {target} IS NOT NULL "
            f"AND {other} IS NOT NULL GROUP BY 1, 2, 3) dd)) WHERE cum - n < 5) GROUP BY qk)")


_KNN_FLOW_SQL = (
    f"WITH raw AS (SELECT {', '.join(_KNN_COLS)} FROM part), "
    f"l AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s, p_retailprice AS r, CAST(d.code AS DOUBLE) AS label FROM raw "
    f"JOIN {_dict('raw', 'p_type')} d ON coalesce(raw.p_type, 'nan') = d.v), "
    f"sp AS {_strat_split('l', _HP)}, "
    f"k AS (SELECT *, md5(coalesce(CAST(s AS VARCHAR), '') || '|' || coalesce(CAST(r AS VARCHAR), '')) AS key FROM sp), "
    f"f AS (SELECT p_partkey, split, label, CASE WHEN s IS NULL THEN coalesce(a.imp, (SELECT avg(s) FROM k WHERE split = 'train')) "
    f"ELSE s END AS p_size, CASE WHEN r IS NULL THEN coalesce(b.imp, (SELECT avg(r) FROM k WHERE split = 'train')) ELSE r END "
    f"AS p_retailprice FROM k LEFT JOIN {_neighbour_sql('s', 'r')} a ON k.key = a.qk "
    f"LEFT JOIN {_neighbour_sql('r', 's')} b ON k.key = b.qk), "
    f"st AS (SELECT {_std(['p_size', 'p_retailprice'], 'f')}) "
    f"SELECT p_partkey, round((p_size - a_p_size) / b_p_size, 6) AS p_size, "
    f"round((p_retailprice - a_p_retailprice) / b_p_retailprice, 6) AS p_retailprice, label FROM f, st")


def _knn_flow(spark, d):
    raw = table(spark, d, "part").selectExpr(*_KNN_COLS)
    return raw, PR.prep_quick(raw, "p_type", ["p_partkey"], missing="knn")


@register("prep_apply_knn", _KNN_FLOW_SQL)
def q_prep_apply_knn(spark, d):
    """Fit the quick flow with k-NN fills from the train rows, replay it on the whole raw table."""
    raw, p = _knn_flow(spark, d)
    return round_doubles(p.apply(raw))


@register("stream_apply_knn", _KNN_FLOW_SQL)
def q_stream_apply_knn(spark, d):
    """The same replay on the table read as a stream, micro-batch by micro-batch."""
    from sparkwright.streaming.apply import read_stream, replay_to_files
    _, p = _knn_flow(spark, d)
    schema = table(spark, d, "part").schema
    stream = read_stream(spark, d, schema, file_glob="part.parquet")
    path = replay_to_files(stream, p, pre=lambda s: s.selectExpr(*_KNN_COLS))
    return round_doubles(spark.read.parquet(path).drop("batch"))
