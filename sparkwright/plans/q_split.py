"""Registered split / fold queries (I1-I6) with SQL oracles."""

from __future__ import annotations

from sparkwright.operators import split as SP
from sparkwright.plans.registry import register
from sparkwright.plans.tables import table

_H = "md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR)))"


@register("split_random",
          f"SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (ORDER BY {_H}) <= "
          f"ceil(CAST(count(*) OVER () AS DOUBLE) * 0.2) THEN 'test' ELSE 'train' END AS split FROM orders")
def q_split_random(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return SP.split_random(df, ["o_orderkey"], 0.2)


def _quota_sql(src, label, test_size=0.2):
    return (f"(SELECT {label}, n_c, CAST(n_c - (fl + CASE WHEN rk <= need THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM ("
            f"SELECT *, ntr - sum(fl) OVER () AS need, row_number() OVER (ORDER BY cont - fl DESC, {label}) AS rk "
            f"FROM (SELECT *, floor(cont) AS fl FROM (SELECT *, CAST(ntr AS DOUBLE) * n_c / n AS cont FROM ("
            f"SELECT {label}, n_c, sum(n_c) OVER () AS n, sum(n_c) OVER () - ceil(CAST(sum(n_c) OVER () AS DOUBLE) "
            f"* {test_size}) AS ntr FROM (SELECT {label}, count(*) AS n_c FROM {src} GROUP BY {label}))))))")


@register("split_stratified",
          f"SELECT o.o_orderkey, o.o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o.o_orderstatus "
          f"ORDER BY {_H}) <= qt.quota THEN 'test' ELSE 'train' END AS split FROM orders o "
          f"JOIN {_quota_sql('orders', 'o_orderstatus')} qt ON o.o_orderstatus = qt.o_orderstatus")
def q_split_stratified(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return SP.split_stratified(df, ["o_orderkey"], "o_orderstatus", 0.2)


def _can_sql(src, label, name):
    return (f"SELECT '{name}' AS target, CAST(n_rows AS BIGINT) AS n_rows, n_classes, min_class, n_test, stratify, CASE WHEN stratify THEN "
            f"'stratified' ELSE 'random' END AS method FROM (SELECT *, min_class >= 2 AND n_test >= n_classes AND "
            f"n_rows - n_test >= n_classes AS stratify FROM (SELECT sum(n_c) AS n_rows, count(*) AS n_classes, "
            f"min(n_c) AS min_class, CAST(ceil(CAST(sum(n_c) AS DOUBLE) * 0.2) AS BIGINT) AS n_test FROM "
            f"(SELECT {label}, count(*) AS n_c FROM {src} GROUP BY {label})))")


@register("split_fallback_choice",
          f"SELECT * FROM ({_can_sql('labels', 'toxic', 'labels.toxic')}) UNION ALL "
          f"SELECT * FROM ({_can_sql('customer', 'c_custkey', 'customer.c_custkey')}) UNION ALL "
          f"SELECT * FROM ({_can_sql('orders', 'o_orderstatus', 'orders.o_orderstatus')})")
def q_split_fallback_choice(spark, d):
    from pyspark.sql import functions as F
    parts = [SP.can_stratify(table(spark, d, "labels"), "toxic").withColumn("target", F.lit("labels.toxic")),
             SP.can_stratify(table(spark, d, "customer"), "c_custkey").withColumn("target", F.lit("customer.c_custkey")),
             SP.can_stratify(table(spark, d, "orders"), "o_orderstatus")
             .withColumn("target", F.lit("orders.o_orderstatus"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("cv_folds",
          f"SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_H}) - 1) "
          f"% 5 AS INTEGER) AS fold FROM orders")
def q_cv_folds(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return SP.cv_folds(df, ["o_orderkey"], "o_orderstatus", 5)


@register("cv_folds_plain",
          "SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders")
def q_cv_folds_plain(spark, d):
    df = table(spark, d, "orders").select("o_orderkey")
    return SP.cv_folds_plain(df, ["o_orderkey"], 5)


@register("split_quotas", f"SELECT o_orderstatus, n_c, quota FROM {_quota_sql('orders', 'o_orderstatus')}")
def q_split_quotas(spark, d):
    return SP.stratified_quotas(table(spark, d, "orders"), "o_orderstatus", 0.2).select("o_orderstatus", "n_c", "quota")
