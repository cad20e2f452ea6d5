"""Registered second-tier option queries (P1-P14) with SQL oracles where one exists."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwright.operators import features as FE
from sparkwright.operators import scale as SC
from sparkwright.plans.registry import register
from sparkwright.plans.tables import events_nulls, events_nulls_sql, round_doubles, table

# ------------------------------------------------------------------ P2
@register("balance_weights",
          "SELECT o_orderstatus, count(*) AS n_c, round(CAST((SELECT count(*) FROM orders) AS DOUBLE) / "
          "((SELECT count(DISTINCT o_orderstatus) FROM orders) * count(*)), 6) AS weight FROM orders GROUP BY 1")
def q_balance_weights(spark, d):
    return round_doubles(FE.class_weights(table(spark, d, "orders"), "o_orderstatus"))


# ------------------------------------------------------------------ P3
_FS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _anova_sql(feats, label, src):
    parts = []
    for c in feats:
        parts.append(
            f"SELECT '{c}' AS feature, round(((B - S * S / N) / (K - 1)) / ((Q - B) / (N - K)), 6) AS f_score FROM "
            f"(SELECT sum(n) AS N, count(*) AS K, sum(s) AS S, sum(q) AS Q, sum(s * s / n) AS B FROM "
            f"(SELECT count(*) AS n, sum(CAST({c} AS DOUBLE)) AS s, sum(CAST({c} AS DOUBLE) * CAST({c} AS DOUBLE)) "
            f"AS q FROM {src} GROUP BY {label}))")
    return " UNION ALL ".join(parts)


@register("feature_scores", _anova_sql(_FS, "l_returnflag", "lineitem"))
def q_feature_scores(spark, d):
    return round_doubles(FE.anova_f_scores(table(spark, d, "lineitem"), _FS, "l_returnflag"))


# ------------------------------------------------------------------ P4
EV3 = ["event_id", "user_id", "value"]
EVS = events_nulls_sql(EV3)


def _fence(c, k=1.5):
    q1, q3 = f"(SELECT quantile_cont({c}, 0.25) FROM {EVS})", f"(SELECT quantile_cont({c}, 0.75) FROM {EVS})"
    return f"({q1} - {k} * ({q3} - {q1}))", f"({q3} + {k} * ({q3} - {q1}))"


@register("outlier_remove_all",
          f"SELECT event_id, user_id, round(value, 6) AS value FROM {EVS} WHERE "
          + " AND ".join(f"{c} BETWEEN {_fence(c)[0]} AND {_fence(c)[1]}" for c in ["user_id", "value"]))
def q_outlier_remove_all(spark, d):
    return round_doubles(SC.remove_outliers_iqr(events_nulls(spark, d, EV3), ["user_id", "value"]))


# ------------------------------------------------------------------ P11
@register("encode_binary",
          "WITH d AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS BIGINT) AS code FROM "
          "(SELECT DISTINCT coalesce(p_brand, 'nan') AS v FROM part)) SELECT p_partkey, p_type, "
          + ", ".join(f"CAST((code >> {4 - i}) & 1 AS INTEGER) AS p_brand_bin_{i}" for i in range(5))
          + " FROM part JOIN d ON coalesce(p_brand, 'nan') = d.v")
def q_encode_binary(spark, d):
    return FE.encode_binary(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), "p_brand")


@register("encode_target_mean",
          "WITH t AS (SELECT o_orderpriority AS k, avg(o_totalprice) AS m FROM orders GROUP BY 1) "
          "SELECT o_orderkey, round(t.m, 6) AS o_orderpriority, round(o_totalprice, 6) AS o_totalprice "
          "FROM orders JOIN t ON o_orderpriority = t.k")
def q_encode_target_mean(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return round_doubles(FE.encode_target_mean(df, "o_orderpriority", "o_totalprice"))


@register("encode_hash",
          "SELECT c_custkey, CAST(('0x' || substr(md5(c_name), 1, 8))::BIGINT % 32 AS BIGINT) AS c_name FROM customer")
def q_encode_hash(spark, d):
    return FE.encode_hash(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", 32)


# ------------------------------------------------------------------ P12
@register("polynomial_features",
          "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity, 6) AS l_quantity, "
          "round(l_discount, 6) AS l_discount, round(l_quantity * l_quantity, 6) AS \"l_quantity^2\", "
          "round(l_quantity * l_discount, 6) AS \"l_quantity*l_discount\", "
          "round(l_discount * l_discount, 6) AS \"l_discount^2\" FROM lineitem")
def q_polynomial_features(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                            "l_quantity", "l_discount")
    return round_doubles(FE.polynomial_features(df, ["l_quantity", "l_discount"]))


@register("derived_features",
          "SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal, round(CASE WHEN c_acctbal > -1 THEN ln(1 + c_acctbal) END, 6) "
          "AS c_acctbal_log, round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 6) AS c_acctbal_sqrt, "
          "round(CASE WHEN c_acctbal <> 0 THEN 1.0 / c_acctbal END, 6) AS c_acctbal_reciprocal FROM customer")
def q_derived_features(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return round_doubles(FE.derived_features(df, ["c_acctbal"]))


# ------------------------------------------------------------------ P13 / P1 / P14 (no SQL form but P13)
_NEAR_COPIES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "revenue"]


def _collinear_sql(cols, threshold):
    """The greedy pass as one step per column, each of which knows the columns dropped before it."""
    pairs = [(i, j) for j in range(len(cols)) for i in range(j)]
    near = ", ".join(f"abs(corr({cols[i]}, {cols[j]})) > {threshold} AS r_{i}_{j}" for i, j in pairs)
    steps = ["s0 AS (SELECT *, FALSE AS d_0 FROM near)"]
    for j in range(1, len(cols)):
        test = " OR ".join(f"(NOT d_{i} AND r_{i}_{j})" for i in range(j))
        steps.append(f"s{j} AS (SELECT *, {test} AS d_{j} FROM s{j - 1})")
    rows = " UNION ALL ".join(f"SELECT '{c}' AS dropped FROM s{len(cols) - 1} WHERE d_{j}" for j, c in enumerate(cols))
    return (f"WITH li AS (SELECT *, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem), "
            f"near AS (SELECT {near} FROM li), {', '.join(steps)} {rows}")


@register("collinear_drop", _collinear_sql(_NEAR_COPIES, 0.9))
def q_collinear_drop(spark, d):
    """Features dropped for |corr| > 0.9 among lineitem's numeric columns plus
    the discounted price, a near-copy of the price (greedy in column order)."""
    df = table(spark, d, "lineitem").withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    dropped = FE.collinear_to_drop(df, _NEAR_COPIES, 0.9)
    return spark.createDataFrame([(c,) for c in dropped], "dropped string")


@register("pca_variance")
def q_pca_variance(spark, d):
    """Components kept for 90 % of the variance of the embeddings."""
    from pyspark.ml.functions import array_to_vector
    e = table(spark, d, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    _, k, share = FE.pca_keep_variance(e, 0.9)
    return spark.createDataFrame([(k, share)], "n_components int, explained_variance double")


@register("grid_search")
def q_grid_search(spark, d):
    """3-fold grid search of logistic-regression regularisation on the embeddings
    (as many iterations as the Logistic Regression learner allows)."""
    from pyspark.ml.classification import LogisticRegression
    from sparkwright.plans.q_models import embedding_frame
    data = embedding_frame(spark, d).where(F.col("split") == "train").drop("split")
    _, scores = FE.grid_search(LogisticRegression(maxIter=1000), {"regParam": [0.0, 0.01, 0.1]}, data, folds=3)
    return round_doubles(scores)


@register("random_search")
def q_random_search(spark, d):
    """Six seeded draws of a decision tree's depth and leaf size on the train embeddings, poor ones stopped early."""
    from sparkwright.plans.q_models import embedding_frame
    data = embedding_frame(spark, d).where(F.col("split") == "train").drop("split")
    _, _, scores = FE.random_search("Decision Tree", {"max_depth": (2, 12), "min_samples_leaf": [1, 5, 20]}, data, ["vec_id"], 6)
    return round_doubles(scores)
