"""Registered profiling / validation queries (A, B, D) with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwright.operators import profile as P
from sparkwright.operators import quality as Q
from sparkwright.plans.registry import r6, register, union_all
from sparkwright.plans.tables import (LINEITEM_COLS, lineitem_nulls, lineitem_nulls_sql,
                                      orders_nulls, orders_nulls_sql, round_doubles, table,
                                      events_nulls, events_nulls_sql)

LI = lineitem_nulls_sql()
LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
          "l_extendedprice", "l_discount", "l_tax"]
LI_TEXT = ["l_returnflag", "l_linestatus"]
LI_ALL = LINEITEM_COLS
LI_NOTS = [c for c in LINEITEM_COLS if c != "l_shipdate"]
LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

_DTYPE_SQL = ("CASE data_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' "
              "WHEN 'DOUBLE' THEN 'float64' WHEN 'FLOAT' THEN 'float32' WHEN 'VARCHAR' THEN 'object' "
              "WHEN 'BOOLEAN' THEN 'bool' WHEN 'TIMESTAMP' THEN 'datetime64[ns]' "
              "ELSE lower(data_type) END")


def _present_sql(src, cols, names=None):
    return union_all([f"SELECT '{n}' AS column_name, count({c}) AS n_values FROM {src}"
                      for c, n in zip(cols, names or cols)])


# ------------------------------------------------------------------ D1
@register("table_shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_cols, "
          "count(*) = 0 AS is_empty FROM lineitem")
def q_table_shape(spark, d):
    return P.table_shape(table(spark, d, "lineitem"))


# ------------------------------------------------------------------ D2
def _missing_sql(src, cols):
    parts = [f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
             f"count(*) AS n_rows FROM {src}" for c in cols]
    return (f"SELECT column_name, missing_count, "
            f"round(CAST(missing_count AS DOUBLE) * 100 / n_rows, 6) AS missing_pct, "
            f"missing_count = n_rows AS all_missing FROM ({union_all(parts)}) WHERE missing_count > 0")


@register("profile_missing", _missing_sql(LI, LI_ALL))
def q_profile_missing(spark, d):
    return round_doubles(P.profile_missing(lineitem_nulls(spark, d)))


def _missing_summary_sql(src, cols):
    n = len(cols)
    tot = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)
    with_m = " + ".join(f"CASE WHEN count(*) FILTER (WHERE {c} IS NULL) > 0 THEN 1 ELSE 0 END" for c in cols)
    all_m = " + ".join(f"CASE WHEN count(*) FILTER (WHERE {c} IS NULL) = count(*) THEN 1 ELSE 0 END"
                       for c in cols)
    return (f"SELECT count(*) * {n} AS total_cells, CAST({tot} AS BIGINT) AS total_missing, "
            f"round(CAST({tot} AS DOUBLE) * 100 / (count(*) * {n}), 6) AS total_missing_pct, "
            f"CAST({with_m} AS BIGINT) AS n_columns_with_missing, "
            f"CAST({all_m} AS BIGINT) AS n_all_missing_columns FROM {src}")


@register("missing_summary", _missing_summary_sql(LI, LI_ALL))
def q_missing_summary(spark, d):
    return round_doubles(P.missing_summary(lineitem_nulls(spark, d)))


# ------------------------------------------------------------------ D3
@register("profile_dtypes",
          f"WITH present AS ({_present_sql(LI, LI_ALL)}) SELECT {_DTYPE_SQL} AS dtype, count(*) AS n_columns, "
          f"CAST(sum(n_values) AS BIGINT) AS n_values FROM information_schema.columns JOIN present USING (column_name) "
          f"WHERE table_name = 'lineitem' GROUP BY 1")
def q_profile_dtypes(spark, d):
    return P.profile_dtypes(lineitem_nulls(spark, d))


# ------------------------------------------------------------------ D4
DUP_COLS = LINEITEM_COLS


@register("duplicate_rows",
          f"SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(DUP_COLS)} "
          f"FROM {LI})) AS n_distinct, count(*) - (SELECT count(*) FROM (SELECT DISTINCT "
          f"{', '.join(DUP_COLS)} FROM {LI})) AS n_duplicates FROM lineitem")
def q_duplicate_rows(spark, d):
    return P.duplicate_rows(lineitem_nulls(spark, d, DUP_COLS))


@register("duplicate_documents",
          "SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM documents)) "
          "AS n_distinct, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM documents)) "
          "AS n_duplicates FROM documents")
def q_duplicate_documents(spark, d):
    return P.duplicate_rows(table(spark, d, "documents"))


# ------------------------------------------------------------------ D6
def _bounds_sql(src, cols, k=1.5):
    parts = [f"SELECT '{c}' AS column_name, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 "
             f"FROM {src}" for c in cols]
    return (f"SELECT column_name, q1, q3, q1 - {k} * (q3 - q1) AS lower_bound, "
            f"q3 + {k} * (q3 - q1) AS upper_bound FROM ({union_all(parts)})")


def _outlier_sql(src, cols, k=1.5, only=True):
    counts = union_all([
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} < b.lower_bound OR {c} > b.upper_bound) "
        f"AS n_outliers, count(*) AS n_rows FROM {src}, (SELECT * FROM bounds WHERE column_name = '{c}') b"
        for c in cols])
    where = "WHERE n_outliers > 0" if only else ""
    return (f"WITH bounds AS ({_bounds_sql(src, cols, k)}), counts AS ({counts}) "
            f"SELECT b.column_name, {r6('q1')} AS q1, {r6('q3')} AS q3, {r6('lower_bound')} AS lower_bound, "
            f"{r6('upper_bound')} AS upper_bound, n_outliers, "
            f"round(CAST(n_outliers AS DOUBLE) * 100 / n_rows, 6) AS outlier_pct "
            f"FROM bounds b JOIN counts c ON b.column_name = c.column_name {where}")


@register("outlier_stats", f"SELECT * FROM ({_outlier_sql(LI, LI_NUM)}) UNION ALL SELECT * FROM (" +
          _outlier_sql(events_nulls_sql(["event_id", "user_id", "value"]), ["event_id", "user_id", "value"]) + ")")
def q_outlier_stats(spark, d):
    a = P.outlier_stats(lineitem_nulls(spark, d))
    b = P.outlier_stats(events_nulls(spark, d, ["event_id", "user_id", "value"]))
    return round_doubles(a.unionByName(b))


# ------------------------------------------------------------------ D8
def _describe_sql(src, cols):
    parts = [f"SELECT '{c}' AS column_name, count({c}) AS count, {r6(f'avg({c})')} AS mean, "
             f"{r6(f'stddev_samp({c})')} AS std, {r6(f'min({c})')} AS min, "
             f"{r6(f'quantile_cont({c}, 0.25)')} AS p25, {r6(f'quantile_cont({c}, 0.5)')} AS p50, "
             f"{r6(f'quantile_cont({c}, 0.75)')} AS p75, {r6(f'max({c})')} AS max FROM {src}"
             for c in cols]
    return union_all(parts)


@register("describe", _describe_sql(LI, LI_NUM))
def q_describe(spark, d):
    return round_doubles(P.describe(lineitem_nulls(spark, d)))


# ------------------------------------------------------------------ D9
@register("nunique", union_all([f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique FROM {LI}"
                                for c in LI_ALL]))
def q_nunique(spark, d):
    return P.nunique(lineitem_nulls(spark, d))


# ------------------------------------------------------------------ D10
MODE_TEXT = ["l_returnflag", "l_linestatus", "l_shipdate"]
MODE_NUM = [c for c in LINEITEM_COLS if c not in MODE_TEXT]


def _mode_sql(src, c, numeric):
    pick = (f"(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM {src} WHERE {c} IS NOT NULL "
            f"GROUP BY {c}) ORDER BY n DESC, v LIMIT 1)")
    if numeric:
        return f"SELECT '{c}' AS column_name, CAST(NULL AS VARCHAR) AS mode_text, {r6(pick)} AS mode_number"
    return f"SELECT '{c}' AS column_name, CAST({pick} AS VARCHAR) AS mode_text, CAST(NULL AS DOUBLE) AS mode_number"


@register("mode_value", union_all([_mode_sql(LI, c, False) for c in MODE_TEXT] +
                                  [_mode_sql(LI, c, True) for c in MODE_NUM]))
def q_mode_value(spark, d):
    return round_doubles(P.mode_values(lineitem_nulls(spark, d), MODE_TEXT + MODE_NUM))


# ------------------------------------------------------------------ D12
SKEW_COLS = [c for c in LINEITEM_COLS if c not in ("l_returnflag", "l_linestatus", "l_shipdate")]


@register("skewness", union_all(
    [f"SELECT '{c}' AS column_name, {r6(f'skewness({c})')} AS skewness FROM {LI}" for c in SKEW_COLS] +
    [f"SELECT 'value' AS column_name, {r6('skewness(value)')} AS skewness FROM {events_nulls_sql()}"]))
def q_skewness(spark, d):
    a = P.skewness(lineitem_nulls(spark, d), SKEW_COLS)
    b = P.skewness(events_nulls(spark, d), ["value"])
    return round_doubles(a.unionByName(b))


# ------------------------------------------------------------------ D13/D14/D15
@register("value_counts",
          f"SELECT l_returnflag AS value, count(*) AS count, "
          f"round(CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM lineitem), 6) AS pct "
          f"FROM {LI} WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag")
def q_value_counts(spark, d):
    return round_doubles(P.value_counts(lineitem_nulls(spark, d), "l_returnflag"))


OR = orders_nulls_sql()


@register("value_freq",
          f"SELECT o_orderpriority AS value, count(*) AS count, "
          f"round(CAST(count(*) AS DOUBLE) * 100 / (SELECT count(o_orderpriority) FROM {OR}) / 100, 6) AS freq "
          f"FROM {OR} WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority")
def q_value_freq(spark, d):
    return round_doubles(P.value_freq(orders_nulls(spark, d), "o_orderpriority"))


RARE_COLS = ["p_brand", "p_type", "p_name"]


def _rare_sql(src, c, thr=0.05):
    return (f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE f < {thr}) AS n_rare, count(*) AS n_categories "
            f"FROM (SELECT CAST(count(*) AS DOUBLE) * 100 / (SELECT count({c}) FROM {src}) / 100 AS f "
            f"FROM {src} WHERE {c} IS NOT NULL GROUP BY {c})")


@register("rare_category_count", union_all([_rare_sql("part", c) for c in RARE_COLS]))
def q_rare_category_count(spark, d):
    return P.rare_category_count(table(spark, d, "part"), RARE_COLS)


# ------------------------------------------------------------------ D16
def _hist_sql(src, c, bins=30):
    return (f"WITH r AS (SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END AS lo, "
            f"CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END AS hi FROM {src}), "
            f"b AS (SELECT CAST(least(floor(({c} - lo) * {bins} / (hi - lo)), {bins - 1}) AS INTEGER) AS bin, "
            f"count(*) AS n FROM {src}, r WHERE {c} IS NOT NULL GROUP BY 1), "
            f"g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(0, {bins})) "
            f"SELECT g.bin, {r6(f'lo + g.bin * ((hi - lo) / {bins})')} AS bin_lo, "
            f"{r6(f'lo + (g.bin + 1) * ((hi - lo) / {bins})')} AS bin_hi, CAST(coalesce(n, 0) AS BIGINT) AS count "
            f"FROM g CROSS JOIN r LEFT JOIN b ON g.bin = b.bin")


@register("histogram30", _hist_sql(events_nulls_sql(), "value"))
def q_histogram30(spark, d):
    return round_doubles(P.histogram(events_nulls(spark, d), "value", 30))


# ------------------------------------------------------------------ D17
CORR_COLS = SKEW_COLS


@register("correlation_pairs", union_all([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r6(f'corr({a}, {b})')} AS corr FROM {LI}"
    for i, a in enumerate(CORR_COLS) for b in CORR_COLS[:i]]))
def q_correlation_pairs(spark, d):
    return round_doubles(P.correlation_pairs(lineitem_nulls(spark, d), CORR_COLS))


# ------------------------------------------------------------------ B14 / D24
_LI_DTYPES = {"l_orderkey": "int64", "l_partkey": "int64", "l_suppkey": "int64", "l_linenumber": "int32",
              "l_quantity": "float64", "l_extendedprice": "float64", "l_discount": "float64",
              "l_tax": "float64", "l_returnflag": "object", "l_linestatus": "object",
              "l_shipdate": "datetime64[ns]"}


@register("column_info", union_all([
    f"SELECT '{c}' AS column_name, '{_LI_DTYPES[c]}' AS dtype, count({c}) AS non_null, "
    f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS n_unique, "
    f"round(CAST(count(*) - count({c}) AS DOUBLE) * 100 / count(*), 6) AS missing_pct FROM {LI}"
    for c in LI_ALL]))
def q_column_info(spark, d):
    return round_doubles(P.column_info(lineitem_nulls(spark, d)))


# ------------------------------------------------------------------ D5
_RENAMED = {"l_orderkey": "Unnamed: 0", "l_quantity": "qty (units)", "l_discount": "disc%",
            "l_tax": "l_tax", "l_returnflag": "return flag", "l_linestatus": "status/now"}
_RENAMED_SQL = "SELECT " + ", ".join(f'{k} AS "{v}"' for k, v in _RENAMED.items()) + " FROM lineitem"


@register("column_name_issues",
          f"SELECT issue, column_name, n_values FROM ("
          f"SELECT 'unnamed' AS issue, column_name FROM (DESCRIBE {_RENAMED_SQL}) "
          f"WHERE column_name LIKE 'Unnamed:%' UNION ALL "
          f"SELECT 'special_characters' AS issue, column_name FROM (DESCRIBE {_RENAMED_SQL}) "
          f"WHERE NOT regexp_full_match(replace(replace(column_name, '_', ''), ' ', ''), '[A-Za-z0-9]+') "
          f"AND column_name NOT LIKE 'Unnamed:%') JOIN ({_present_sql(LI, _RENAMED, _RENAMED.values())}) USING (column_name)")
def q_column_name_issues(spark, d):
    df = lineitem_nulls(spark, d).select(*[F.col(k).alias(v) for k, v in _RENAMED.items()])
    return Q.column_name_issues(df)


# ------------------------------------------------------------------ D18
@register("suggest_targets", union_all([
    f"SELECT '{c}' AS column_name, '{_LI_DTYPES[c]}' AS dtype, count(DISTINCT {c}) AS n_unique FROM {LI} "
    f"HAVING count(DISTINCT {c}) " + ("BETWEEN 2 AND 10" if c in LI_TEXT else "<= 20")
    for c in LI_NUM + LI_TEXT]))
def q_suggest_targets(spark, d):
    return Q.suggest_targets(lineitem_nulls(spark, d))


# ------------------------------------------------------------------ D19
def _advice_sql(src, num, txt, other, bin_kw):
    rows = []
    for c in num:
        rows.append(
            f"SELECT '{c}' AS column_name, 'numeric' AS tc, CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) "
            f"* 100 / count(*) AS mp, count(DISTINCT {c}) AS nu, coalesce(skewness({c}), 0) AS sk, "
            f"(SELECT n_outliers FROM outl WHERE column_name = '{c}') AS no, CAST(NULL AS BIGINT) AS nr FROM {src}")
    for c in txt:
        rows.append(
            f"SELECT '{c}', 'text', CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) * 100 / count(*), "
            f"count(DISTINCT {c}), 0.0, CAST(NULL AS BIGINT), "
            f"(SELECT count(*) FILTER (WHERE f < 0.05) FROM (SELECT CAST(count(*) AS DOUBLE) * 100 / "
            f"(SELECT count({c}) FROM {src}) / 100 AS f FROM {src} WHERE {c} IS NOT NULL GROUP BY {c})) FROM {src}")
    for c in other:
        rows.append(f"SELECT '{c}', 'datetime', CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) * 100 / count(*), "
                    f"count(DISTINCT {c}), 0.0, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM {src}")
    kw = " OR ".join(f"contains(lower(column_name), '{k}')" for k in bin_kw)
    num_c, txt_c = "tc = 'numeric'", "tc = 'text'"
    parts = [
        f"CASE WHEN mp > 50 THEN 'impute:drop_column' WHEN mp > 0 AND {num_c} AND sk > 1 THEN 'impute:median' "
        f"WHEN mp > 0 AND {num_c} THEN 'impute:mean' WHEN mp > 0 THEN 'impute:mode' END",
        f"CASE WHEN {num_c} AND ({kw}) THEN 'bin' END",
        f"CASE WHEN {num_c} AND abs(sk) > 1 THEN 'transform:log_sqrt' END",
        f"CASE WHEN {num_c} AND no > 0 THEN 'clip:' || CAST(no AS VARCHAR) || '_outliers' END",
        f"CASE WHEN {num_c} THEN 'scale' END",
        f"CASE WHEN {txt_c} AND nu = 2 THEN 'encode:binary' WHEN {txt_c} AND nu > 10 THEN "
        f"'encode:label_or_frequency:' || CAST(nu AS VARCHAR) WHEN {txt_c} THEN 'encode:onehot' END",
        f"CASE WHEN {txt_c} AND nr > 0 THEN 'group_rare:' || CAST(nr AS VARCHAR) END",
    ]
    joined = f"concat_ws(' | ', {', '.join(parts)})"
    return (f"WITH outl AS ({_outlier_sql(src, num, only=False)}), prof AS ({union_all(rows)}) "
            f"SELECT column_name, CASE WHEN {joined} = '' THEN 'none' ELSE {joined} END AS advice FROM prof")


@register("suggest_preprocessing", _advice_sql(LI, LI_NUM, LI_TEXT, ["l_shipdate"], Q.BIN_KEYWORDS_ADVICE))
def q_suggest_preprocessing(spark, d):
    return Q.suggest_preprocessing(lineitem_nulls(spark, d))


# ------------------------------------------------------------------ D20
@register("binnable_columns", union_all([
    f"SELECT '{c}' AS column_name, ("
    + " OR ".join(f"contains(lower('{c}'), '{k}')" for k in Q.BIN_KEYWORDS)
    + (" OR u > 20" if c in LI_NUM else "") + f") AS binnable FROM (SELECT count(DISTINCT {c}) AS u FROM lineitem)"
    for c in LI_ALL]))
def q_binnable_columns(spark, d):
    return Q.binnable_columns(table(spark, d, "lineitem"))


# ------------------------------------------------------------------ D21/D22
TASK_COLS = LINEITEM_COLS


@register("task_type", union_all([
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique, count(*) AS n_rows, "
    f"round(CAST(count(DISTINCT {c}) AS DOUBLE) / count(*), 6) AS unique_ratio, "
    + ("true" if c in LI_TEXT else f"(count(DISTINCT {c}) < 20 OR CAST(count(DISTINCT {c}) AS DOUBLE) / count(*) < 0.05)")
    + " AS is_classification, "
    + ("true" if c in LI_TEXT else f"count(DISTINCT {c}) < 20") + f" AS is_classification_custom FROM {LI}"
    for c in TASK_COLS]))
def q_task_type(spark, d):
    return round_doubles(Q.task_type(lineitem_nulls(spark, d), TASK_COLS))


# ------------------------------------------------------------------ D23
@register("target_info",
          f"SELECT 'l_returnflag' AS column_name, 'object' AS original_dtype, count(DISTINCT l_returnflag) AS n_unique, "
          f"'classification' AS task_type, true AS needs_encoding, "
          f"string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS classes FROM {LI}")
def q_target_info(spark, d):
    return Q.target_info(lineitem_nulls(spark, d), "l_returnflag")


# ------------------------------------------------------------------ D7
def _validate_sql(src, cols, num, txt):
    n = len(cols)
    tot = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)
    dist = f"(SELECT count(*) FROM (SELECT DISTINCT * FROM {src}))"
    outl = f"(SELECT count(*) FROM ({_outlier_sql(src, num)}))"
    return (f"WITH s AS (SELECT count(*) AS n, CAST({tot} AS DOUBLE) AS m, count(*) - {dist} AS dup, "
            f"{outl} AS oc FROM {src}) "
            f"SELECT 'statistic' AS kind, 'n_rows' AS item, CAST(n AS DOUBLE) AS value FROM s UNION ALL "
            f"SELECT 'statistic', 'n_cols', {n}.0 FROM s UNION ALL "
            f"SELECT 'statistic', 'total_missing', m FROM s UNION ALL "
            f"SELECT 'statistic', 'total_missing_pct', round(m * 100 / (n * {n}), 6) FROM s UNION ALL "
            f"SELECT 'statistic', 'duplicate_rows', CAST(dup AS DOUBLE) FROM s UNION ALL "
            f"SELECT 'statistic', 'n_numeric_columns', {len(num)}.0 FROM s UNION ALL "
            f"SELECT 'statistic', 'n_text_columns', {len(txt)}.0 FROM s UNION ALL "
            f"SELECT 'statistic', 'n_outlier_columns', CAST(oc AS DOUBLE) FROM s UNION ALL "
            f"SELECT 'statistic', 'is_valid', 1.0 FROM s UNION ALL "
            f"SELECT 'warning', 'high_missing', round(m * 100 / (n * {n}), 6) FROM s WHERE m * 100 / (n * {n}) > 50 "
            f"UNION ALL SELECT 'warning', 'duplicate_rows', CAST(dup AS DOUBLE) FROM s WHERE dup > 0")


VAL_COLS = LINEITEM_COLS


@register("validate_report", _validate_sql(lineitem_nulls_sql(VAL_COLS), VAL_COLS, SKEW_COLS,
                                           ["l_returnflag", "l_linestatus"]))
def q_validate_report(spark, d):
    return round_doubles(Q.validate_report(lineitem_nulls(spark, d, VAL_COLS)))
