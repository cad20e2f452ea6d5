"""Registered preparation queries (B, C, E, F, G, H) with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwright.operators import binning as BN
from sparkwright.operators import encode as EN
from sparkwright.operators import impute as IM
from sparkwright.operators import scale as SC
from sparkwright.operators import split as SP
from sparkwright.operators import text as TX
from sparkwright.functions.columns import numeric_columns
from sparkwright.plans.registry import register
from sparkwright.plans.tables import (events_nulls, events_nulls_sql, lineitem_nulls,
                                      lineitem_nulls_sql, orders_nulls, orders_nulls_sql,
                                      round_doubles, table)

LI_F = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
LI_DBL = {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}
LI_NUMS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax"]
LIF = lineitem_nulls_sql(LI_F)
EV3 = ["event_id", "user_id", "value"]
EVS = events_nulls_sql(EV3)
OR_F = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
ORS = orders_nulls_sql(OR_F)


def lif(spark, d):
    return lineitem_nulls(spark, d, LI_F)


def evs(spark, d):
    return events_nulls(spark, d, EV3)


def ors(spark, d):
    return orders_nulls(spark, d, OR_F)


def sel(cols, over=None, dbl=(), digits=6):
    """SQL select list: overrides by column, doubles rounded."""
    over = over or {}
    out = []
    for c in cols:
        e = over.get(c, c)
        if c in dbl:
            e = f"round(CAST({e} AS DOUBLE), {digits})"
        out.append(f"{e} AS \"{c}\"")
    return ", ".join(out)


# ===================================================================== B
@register("project_features", f"SELECT {sel([c for c in LI_F if c != 'l_returnflag'], dbl=LI_DBL)} FROM {LIF}")
def q_project_features(spark, d):
    return round_doubles(lif(spark, d).drop("l_returnflag"))


@register("project_numeric", f"SELECT {sel(LI_NUMS, dbl=LI_DBL)} FROM {LIF}")
def q_project_numeric(spark, d):
    df = lif(spark, d)
    return round_doubles(df.select(*numeric_columns(df)))


@register("drop_nulls", f"SELECT {sel(LI_F, dbl=LI_DBL)} FROM {LIF} WHERE "
          + " AND ".join(f"{c} IS NOT NULL" for c in LI_F))
def q_drop_nulls(spark, d):
    return round_doubles(IM.drop_nulls(lif(spark, d)))


@register("numeric_fill0", f"SELECT {sel(LI_NUMS, {c: f'coalesce({c}, 0)' for c in LI_NUMS}, LI_DBL)} FROM {LIF}")
def q_numeric_fill0(spark, d):
    df = lif(spark, d)
    return round_doubles(df.select(*numeric_columns(df)).fillna(0))


@register("cast_float", f"SELECT {', '.join(f'CAST({c} AS FLOAT) AS {c}' for c in LI_NUMS)} FROM {LIF}")
def q_cast_float(spark, d):
    df = lif(spark, d)
    return df.select(*[F.col(c).cast("float").alias(c) for c in numeric_columns(df)])


_MASK = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]


@register("null_mask", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
          + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}" for c in _MASK) + f" FROM {LIF}")
def q_null_mask(spark, d):
    df = lif(spark, d)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     *[F.col(c).isNull().cast("int").alias(c) for c in _MASK])


@register("preview", f"SELECT {sel(LI_F, dbl=LI_DBL)} FROM lineitem ORDER BY l_orderkey, l_linenumber, "
          f"l_partkey, l_suppkey, l_extendedprice LIMIT 20")
def q_preview(spark, d):
    df = table(spark, d, "lineitem").select(*LI_F)
    return round_doubles(df.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                    "l_extendedprice").limit(20))


# ===================================================================== E
_IMP = ["l_quantity", "l_extendedprice", "l_discount"]


@register("impute_mean", f"SELECT {sel(LI_F, {c: f'coalesce({c}, (SELECT avg({c}) FROM {LIF}))' for c in _IMP}, LI_DBL)} FROM {LIF}")
def q_impute_mean(spark, d):
    return round_doubles(IM.impute_mean(lif(spark, d), _IMP))


@register("impute_median", f"SELECT {sel(LI_F, {c: f'coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM {LIF}))' for c in _IMP}, LI_DBL)} FROM {LIF}")
def q_impute_median(spark, d):
    return round_doubles(IM.impute_median(lif(spark, d), _IMP))


def _mode_sub(src, c):
    return (f"(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}) "
            f"ORDER BY n DESC, v LIMIT 1)")


@register("impute_mode", f"SELECT {sel(LI_F, {'l_returnflag': 'coalesce(l_returnflag, ' + _mode_sub(LIF, 'l_returnflag') + ')'}, LI_DBL)} FROM {LIF}")
def q_impute_mode(spark, d):
    return round_doubles(IM.impute_mode(lif(spark, d), ["l_returnflag"]))


@register("impute_constant", f"SELECT {sel(LI_F, {'l_quantity': 'coalesce(l_quantity, 0.0)', 'l_returnflag': chr(39).join(['coalesce(l_returnflag, ', 'Unknown', ')'])}, LI_DBL)} FROM {LIF}")
def q_impute_constant(spark, d):
    return round_doubles(IM.impute_constant(lif(spark, d), {"l_quantity": 0.0, "l_returnflag": "Unknown"}))


_MM_OVER = {c: f"coalesce({c}, (SELECT avg({c}) FROM {LIF}))" for c in _IMP}
_MM_OVER["l_returnflag"] = "coalesce(l_returnflag, " + _mode_sub(LIF, "l_returnflag") + ")"


@register("impute_mean_mode", f"SELECT {sel(LI_F, _MM_OVER, LI_DBL)} FROM {LIF}")
def q_impute_mean_mode(spark, d):
    return round_doubles(IM.impute_mean_mode(lif(spark, d)))


def _auto_sql(src, cols):
    tot = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)
    n = len(cols)
    return (f"SELECT n_missing, round(missing_ratio, 6) AS missing_ratio, CASE WHEN n_missing = 0 THEN 'none' "
            f"WHEN missing_ratio < 0.05 THEN 'drop' WHEN missing_ratio < 0.30 THEN 'knn' ELSE 'mean_mode' END "
            f"AS strategy FROM (SELECT CAST({tot} AS BIGINT) AS n_missing, CAST({tot} AS DOUBLE) / "
            f"(count(*) * {n}) AS missing_ratio FROM {src})")


@register("impute_auto_choice", f"SELECT * FROM ({_auto_sql(LIF, [c for c in LI_F if c != 'l_returnflag'])}) "
          f"UNION ALL SELECT * FROM ({_auto_sql(EVS, EV3)})")
def q_impute_auto_choice(spark, d):
    a = IM.auto_strategy(lif(spark, d), [c for c in LI_F if c != "l_returnflag"])
    b = IM.auto_strategy(evs(spark, d), EV3)
    return round_doubles(a.unionByName(b))


@register("ffill", "SELECT event_id, user_id, round(last_value(value IGNORE NULLS) OVER (ORDER BY event_id "
          f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS value FROM {EVS}")
def q_ffill(spark, d):
    return round_doubles(IM.ffill(evs(spark, d), "value", ["event_id"]))


@register("bfill", "SELECT event_id, user_id, round(first_value(value IGNORE NULLS) OVER (PARTITION BY user_id "
          f"ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS value FROM {EVS}")
def q_bfill(spark, d):
    return round_doubles(IM.bfill(evs(spark, d), "value", ["event_id"], ["user_id"]))


_W = "PARTITION BY user_id ORDER BY event_id"


@register("interpolate_linear",
          f"WITH r AS (SELECT *, row_number() OVER ({_W}) - 1 AS pos FROM {EVS}), "
          f"n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER ({_W} ROWS "
          f"BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp, last_value(value IGNORE NULLS) OVER ({_W} ROWS "
          f"BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv, first_value(CASE WHEN value IS NOT NULL THEN pos "
          f"END IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np, "
          f"first_value(value IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv "
          f"FROM r) SELECT event_id, user_id, round(CASE WHEN pp IS NULL THEN NULL WHEN np IS NULL THEN pv "
          f"WHEN np = pp THEN pv ELSE pv + (nv - pv) * (CAST(pos AS DOUBLE) - pp) / (CAST(np AS DOUBLE) - pp) END, 6) "
          f"AS value FROM n")
def q_interpolate_linear(spark, d):
    return round_doubles(IM.interpolate_linear(evs(spark, d), "value", ["event_id"], ["user_id"]))


# ===================================================================== F
def _label_dict_sql(src, c):
    return (f"(SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS BIGINT) AS code FROM "
            f"(SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), 'nan') AS v FROM {src}))")


def _label_sql(src, cols, label_cols, dbl):
    joins = " ".join(f"LEFT JOIN {_label_dict_sql(src, c)} d_{c} ON coalesce(CAST(s.{c} AS VARCHAR), 'nan') = d_{c}.v"
                     for c in label_cols)
    over = {c: f"d_{c}.code" for c in label_cols}
    over.update({c: f"s.{c}" for c in cols if c not in label_cols})
    return f"SELECT {sel(cols, over, dbl)} FROM {src} s {joins}"


@register("encode_label", _label_sql(LIF, LI_F, ["l_returnflag", "l_linestatus"], LI_DBL))
def q_encode_label(spark, d):
    return round_doubles(EN.encode_label(lif(spark, d), ["l_returnflag", "l_linestatus"]))


@register("encode_target", _label_sql("orders", OR_F, ["o_orderstatus"], {"o_totalprice"}))
def q_encode_target(spark, d):
    return round_doubles(EN.encode_target(table(spark, d, "orders").select(*OR_F), "o_orderstatus"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _dummies_sql(c, values, prefix="s."):
    return ", ".join(f"CASE WHEN {prefix}{c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for v in values)


@register("encode_onehot", f"SELECT {sel([c for c in OR_F if c != 'o_orderpriority'], dbl={'o_totalprice'})}, "
          f"{_dummies_sql('o_orderpriority', PRIORITIES, '')} FROM {ORS}")
def q_encode_onehot(spark, d):
    return round_doubles(EN.encode_onehot(ors(spark, d), ["o_orderpriority"]))


_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@register("encode_onehot_capped",
          f"SELECT s.p_partkey, d_p_name.code AS p_name, d_p_brand.code AS p_brand, s.p_size, "
          f"round(s.p_retailprice, 6) AS p_retailprice, {_dummies_sql('p_type', P_TYPES)} FROM part s "
          f"LEFT JOIN {_label_dict_sql('part', 'p_name')} d_p_name ON s.p_name = d_p_name.v "
          f"LEFT JOIN {_label_dict_sql('part', 'p_brand')} d_p_brand ON s.p_brand = d_p_brand.v")
def q_encode_onehot_capped(spark, d):
    out, _ = EN.encode_by_cardinality(table(spark, d, "part"), ["p_name", "p_brand", "p_type"], onehot_max=10)
    return round_doubles(out)


@register("encode_mixed",
          f"SELECT s.c_custkey, d_c_name.code AS c_name, s.c_nationkey, round(s.c_acctbal, 6) AS c_acctbal, "
          f"{_dummies_sql('c_mktsegment', SEGMENTS)} FROM customer s "
          f"LEFT JOIN {_label_dict_sql('customer', 'c_name')} d_c_name ON s.c_name = d_c_name.v")
def q_encode_mixed(spark, d):
    out, _ = EN.encode_by_cardinality(table(spark, d, "customer"), ["c_name", "c_mktsegment"], onehot_max=5)
    return round_doubles(out)


@register("encode_frequency",
          f"SELECT {sel(LI_F, {c: 's.' + c for c in LI_F if c != 'l_returnflag'} | {'l_returnflag': 'f.freq'}, LI_DBL | {'l_returnflag'})} "
          f"FROM {LIF} s LEFT JOIN (SELECT l_returnflag AS v, CAST(count(*) AS DOUBLE) / (SELECT count(l_returnflag) "
          f"FROM {LIF}) AS freq FROM {LIF} WHERE l_returnflag IS NOT NULL GROUP BY 1) f ON s.l_returnflag = f.v")
def q_encode_frequency(spark, d):
    return round_doubles(EN.encode_frequency(lif(spark, d), ["l_returnflag"]))


@register("rare_to_other",
          "SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING "
          "CAST(count(*) AS DOUBLE) / (SELECT count(p_brand) FROM part) < 0.04) THEN 'Other' ELSE p_brand END "
          "AS p_brand, p_type FROM part")
def q_rare_to_other(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return EN.rare_to_other(df, ["p_brand"], threshold_pct=4.0)


# ===================================================================== F8-F10
def _ew_sql(src, c, bins):
    lo = f"(SELECT min({c}) FROM {src})"
    hi = f"(SELECT max({c}) FROM {src})"
    adj = f"(CASE WHEN {lo} = {hi} THEN (CASE WHEN {lo} = 0 THEN 0.001 ELSE abs({lo}) * 0.001 END) ELSE 0.0 END)"
    lo2, hi2 = f"({lo} - {adj})", f"({hi} + {adj})"
    terms = " + ".join(f"CASE WHEN {lo2} + {i} * (({hi2} - {lo2}) / {bins}) < CAST({c} AS DOUBLE) THEN 1 ELSE 0 END"
                       for i in range(1, bins))
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE CAST({terms} AS INTEGER) END"


@register("bin_equal_width", f"SELECT {sel(LI_F, {'l_quantity': _ew_sql(LIF, 'l_quantity', 5)}, LI_DBL - {'l_quantity'})} FROM {LIF}")
def q_bin_equal_width(spark, d):
    return round_doubles(BN.bin_equal_width(lif(spark, d), "l_quantity", 5))


def _ef_sql(src, c, nq):
    probs = ", ".join(str(i / nq) for i in range(nq + 1))
    edges = f"(SELECT list_distinct(quantile_cont({c}, [{probs}])) FROM {src})"
    return (f"CASE WHEN {c} IS NULL THEN NULL ELSE CAST(greatest(len(list_filter({edges}, lambda e: e < {c})) - 1, 0) "
            f"AS INTEGER) END")


@register("bin_equal_freq", f"SELECT event_id, user_id, {_ef_sql(EVS, 'value', 5)} AS value FROM {EVS}")
def q_bin_equal_freq(spark, d):
    return BN.bin_equal_freq(evs(spark, d), "value", 5)


EDGES = [0.0, 10000.0, 30000.0, 60000.0, 100000.0]


def _custom_sql(c, edges):
    parts = " ".join(f"WHEN {c} > {edges[i - 1]} AND {c} <= {edges[i]} THEN {i - 1}" for i in range(1, len(edges)))
    return f"CAST(CASE {parts} ELSE NULL END AS INTEGER)"


@register("bin_custom", f"SELECT {sel(LI_F, {'l_extendedprice': _custom_sql('l_extendedprice', EDGES)}, LI_DBL - {'l_extendedprice'})} FROM {LIF}")
def q_bin_custom(spark, d):
    return round_doubles(BN.bin_custom(lif(spark, d), "l_extendedprice", EDGES))


# ===================================================================== G
_SC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scale_sql(src, cols, method, all_cols, dbl):
    over = {}
    for c in cols:
        if method == "standard":
            a, b = f"avg({c})", f"CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END"
        elif method == "minmax":
            a, b = f"min({c})", f"CASE WHEN max({c}) - min({c}) = 0 THEN 1.0 ELSE max({c}) - min({c}) END"
        elif method == "robust":
            a = f"quantile_cont({c}, 0.5)"
            b = (f"CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1.0 "
                 f"ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END")
        else:  # maxabs
            a, b = "0.0", f"CASE WHEN max(abs({c})) = 0 THEN 1.0 ELSE max(abs({c})) END"
        over[c] = f"(CAST(s.{c} AS DOUBLE) - st.a_{c}) / st.b_{c}"
        over.setdefault("__stats", [])
        over["__stats"].append(f"CAST({a} AS DOUBLE) AS a_{c}, CAST({b} AS DOUBLE) AS b_{c}")
    stats = ", ".join(over.pop("__stats"))
    for c in all_cols:
        over.setdefault(c, f"s.{c}")
    return f"SELECT {sel(all_cols, over, dbl | set(cols))} FROM {src} s, (SELECT {stats} FROM {src}) st"


@register("scale_standard", _scale_sql(LIF, _SC, "standard", LI_F, LI_DBL))
def q_scale_standard(spark, d):
    return round_doubles(SC.scale(lif(spark, d), "standard", _SC))


@register("scale_minmax", _scale_sql(LIF, _SC, "minmax", LI_F, LI_DBL))
def q_scale_minmax(spark, d):
    return round_doubles(SC.scale(lif(spark, d), "minmax", _SC))


@register("scale_robust", _scale_sql(LIF, _SC, "robust", LI_F, LI_DBL))
def q_scale_robust(spark, d):
    return round_doubles(SC.scale(lif(spark, d), "robust", _SC))


_CU = ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]


@register("scale_maxabs", _scale_sql("customer", ["c_acctbal"], "maxabs", _CU, set()))
def q_scale_maxabs(spark, d):
    return round_doubles(SC.scale(table(spark, d, "customer").select(*_CU), "maxabs", ["c_acctbal"]))


_SPLIT_SQL = ("(SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR)))) "
              "<= ceil(CAST(count(*) OVER () AS DOUBLE) * 0.2) THEN 'test' ELSE 'train' END AS split FROM {src})")


@register("scale_train_fit",
          f"WITH s AS {_SPLIT_SQL.format(src=ORS)}, st AS (SELECT avg(o_totalprice) AS a, CASE WHEN "
          f"stddev_pop(o_totalprice) = 0 THEN 1.0 ELSE stddev_pop(o_totalprice) END AS b FROM s WHERE split = 'train') "
          f"SELECT o_orderkey, split, round((o_totalprice - a) / b, 6) AS o_totalprice FROM s, st")
def q_scale_train_fit(spark, d):
    df = SP.split_random(ors(spark, d).select("o_orderkey", "o_totalprice"), ["o_orderkey"], 0.2)
    out = SC.scale(df, "standard", ["o_totalprice"], fit_where=F.col("split") == "train")
    return round_doubles(out)


@register("log1p", f"SELECT {sel(_CU, {'c_acctbal': 'CASE WHEN c_acctbal > -1 THEN ln(1 + c_acctbal) END'}, {'c_acctbal'})} FROM customer")
def q_log1p(spark, d):
    return round_doubles(SC.log1p(table(spark, d, "customer").select(*_CU), ["c_acctbal"]))


@register("sqrt", f"SELECT {sel(_CU, {'c_acctbal': 'CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END'}, {'c_acctbal'})} FROM customer")
def q_sqrt(spark, d):
    return round_doubles(SC.sqrt(table(spark, d, "customer").select(*_CU), ["c_acctbal"]))


def _yj_sql(x, lam):
    pos = f"(pow({x} + 1.0, {lam}) - 1.0) / {lam}"
    neg = f"-(pow(-{x} + 1.0, {2 - lam}) - 1.0) / {2 - lam}"
    return f"CASE WHEN {x} >= 0 THEN {pos} ELSE {neg} END"


@register("yeo_johnson_fixed",
          f"WITH t AS (SELECT c_custkey, {_yj_sql('c_acctbal', 0.5)} AS y FROM customer) "
          f"SELECT c_custkey, round((y - (SELECT avg(y) FROM t)) / (SELECT CASE WHEN stddev_pop(y) = 0 THEN 1.0 "
          f"ELSE stddev_pop(y) END FROM t), 6) AS c_acctbal FROM t")
def q_yeo_johnson_fixed(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    out, _ = SC.yeo_johnson(df, ["c_acctbal"], lambdas={"c_acctbal": 0.5})
    return round_doubles(out)


@register("yeo_johnson")
def q_yeo_johnson(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    out, lam = SC.yeo_johnson(df, ["c_acctbal"])
    return round_doubles(out.withColumn("lambda", F.lit(lam["c_acctbal"])))


def _fence(src, c, k=1.5):
    q1, q3 = f"(SELECT quantile_cont({c}, 0.25) FROM {src})", f"(SELECT quantile_cont({c}, 0.75) FROM {src})"
    return f"({q1} - {k} * ({q3} - {q1}))", f"({q3} + {k} * ({q3} - {q1}))"


_LO, _HI = _fence(EVS, "value")


@register("outlier_clip", f"SELECT event_id, user_id, round(CASE WHEN value < {_LO} THEN {_LO} WHEN value > {_HI} "
          f"THEN {_HI} ELSE value END, 6) AS value FROM {EVS}")
def q_outlier_clip(spark, d):
    return round_doubles(SC.clip_iqr(evs(spark, d), ["value"]))


@register("outlier_remove", f"SELECT event_id, user_id, round(value, 6) AS value FROM {EVS} "
          f"WHERE value BETWEEN {_LO} AND {_HI}")
def q_outlier_remove(spark, d):
    return round_doubles(SC.remove_outliers_iqr(evs(spark, d), ["value"]))


@register("winsorize",
          f"SELECT event_id, user_id, round(CASE WHEN value < (SELECT quantile_cont(value, 0.05) FROM {EVS}) THEN "
          f"(SELECT quantile_cont(value, 0.05) FROM {EVS}) WHEN value > (SELECT quantile_cont(value, 0.95) FROM {EVS}) "
          f"THEN (SELECT quantile_cont(value, 0.95) FROM {EVS}) ELSE value END, 6) AS value FROM {EVS}")
def q_winsorize(spark, d):
    return round_doubles(SC.winsorize(evs(spark, d), ["value"]))


# ===================================================================== H
_SPECIAL_SQL = "regexp_replace({x}, '[^a-zA-Z0-9\\s]', '', 'g')"
_NUM_SQL = "regexp_replace({x}, '\\d+', '', 'g')"
_STRIP_SQL = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@register("text_lower", "SELECT c_custkey, lower(c_name) AS c_name, lower(c_mktsegment) AS c_mktsegment FROM customer")
def q_text_lower(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return TX.clean_text(df, ["c_name", "c_mktsegment"], ["lowercase"])


@register("text_remove_special", f"SELECT page_id, {_SPECIAL_SQL.format(x='url')} AS url FROM pages")
def q_text_remove_special(spark, d):
    return TX.clean_text(table(spark, d, "pages").select("page_id", "url"), ["url"], ["remove_special"])


@register("text_remove_numbers", f"SELECT c_custkey, {_NUM_SQL.format(x='c_name')} AS c_name FROM customer")
def q_text_remove_numbers(spark, d):
    return TX.clean_text(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_name"], ["remove_numbers"])


@register("text_strip", f"SELECT conv_id, turn, {_STRIP_SQL.format(x='text')} AS text FROM conversations")
def q_text_strip(spark, d):
    df = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return TX.clean_text(df, ["text"], ["strip"])


_PIPE = _STRIP_SQL.format(x=_NUM_SQL.format(x=_SPECIAL_SQL.format(x="lower(url)")))


@register("text_all_steps", f"SELECT page_id, {_PIPE} AS url FROM pages")
def q_text_all_steps(spark, d):
    df = table(spark, d, "pages").select("page_id", "url")
    return TX.clean_text(df, ["url"], ["lowercase", "remove_special", "remove_numbers", "strip"])


# ===================================================================== E4
_KP = ("(SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size END AS p_size, "
       "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part)")


def _knn_col_sql(target, other):
    """k=5 nearest donors for rows missing `target`, over the one other feature."""
    return (f"(SELECT qk, sum(v * take) / sum(take) AS imp FROM (SELECT qk, v, least(n, 5 - (cum - n)) AS take FROM "
            f"(SELECT *, sum(n) OVER (PARTITION BY qk ORDER BY d2, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
            f"AS cum FROM (SELECT rr.qk, dd.v, dd.n, dd.t, 2.0 * ((rr.o - dd.o) * (rr.o - dd.o)) AS d2 FROM "
            f"(SELECT DISTINCT key AS qk, {other} AS o FROM txt WHERE {target} IS NULL AND {other} IS NOT NULL) rr, "
            f"(SELECT {other} AS o, {target} AS v, key AS t, count(*) AS n FROM txt WHERE {target} IS NOT NULL AND "
            f"{other} IS NOT NULL GROUP BY 1, 2, 3) dd)) WHERE cum - n < 5) GROUP BY qk)")


_KNN_IMPUTE_SQL = (
    f"WITH t AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s, p_retailprice AS r FROM {_KP}), "
    f"txt AS (SELECT *, md5(coalesce(CAST(s AS VARCHAR), '') || '|' || coalesce(CAST(r AS VARCHAR), '')) AS key FROM t) "
    f"SELECT p_partkey, round(CASE WHEN s IS NULL THEN coalesce(a.imp, (SELECT avg(s) FROM t)) ELSE s END, 6) AS p_size, "
    f"round(CASE WHEN r IS NULL THEN coalesce(b.imp, (SELECT avg(r) FROM t)) ELSE r END, 6) AS p_retailprice "
    f"FROM txt LEFT JOIN {_knn_col_sql('s', 'r')} a ON txt.key = a.qk LEFT JOIN {_knn_col_sql('r', 's')} b "
    f"ON txt.key = b.qk")


@register("impute_knn", _KNN_IMPUTE_SQL)
def q_impute_knn(spark, d):
    from sparkwright.operators.knn import impute_knn
    df = table(spark, d, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size END AS p_size",
        "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice")
    return round_doubles(impute_knn(df, id_col="p_partkey", columns=["p_size", "p_retailprice"]))
