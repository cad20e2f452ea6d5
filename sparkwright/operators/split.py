"""Exact, reproducible splits and folds.

The shuffle order of a row is ``md5(seed | id...)``, a pure function of the
row (so a lost task recomputes the same split, and SQL engines agree).  The
first ``quota`` rows of a group in that order are found without sorting the
table: a histogram of the hash's top 16 bits per group locates the bucket of
the quota-th row, only that bucket is ranked, and the resulting threshold is
applied as a filter.  A group holding a third of all rows costs the same as
any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions.columns import q
from sparkwright.operators.ordered import row_position
from sparkwright.functions.columns import attach_one_row

SEED = 42
BUCKET_BITS = 16
BROADCAST_GROUPS = 1_000_000


def shuffle_key(id_cols: Sequence[str], seed: int = SEED) -> Column:
    """Hex md5 of ``seed|id1|id2...``: the row's place in the shuffled order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[q(c).cast("string") for c in id_cols]))


def _prefix(h: Column) -> Column:
    # first 15 hex digits = top 60 bits, a non-negative bigint
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def select_first(df: DataFrame, key: Column, quotas: DataFrame, group_cols: Sequence[str] = (),
                 flag: str = "__sel") -> DataFrame:
    """Flag, per group, the ``quota`` rows with the smallest ``key`` (hex string).

    ``quotas`` has ``group_cols`` + ``quota``.  Exact and tie-free as long as
    keys are unique within a group.  Groups are matched null-safely.
    """
    def gkey(frame):
        return F.to_json(F.struct(*[frame[c] for c in group_cols])) if group_cols else F.lit("")
    h = df.withColumn("__g", gkey(df)).withColumn("__h", key).withColumn("__p", _prefix(F.col("__h"))) \
        .withColumn("__b", F.shiftright(F.col("__p"), 60 - BUCKET_BITS))
    qt = quotas.select(gkey(quotas).alias("__g"), F.col("quota"))
    n_groups = qt.count()

    def side(frame):
        return F.broadcast(frame) if n_groups <= BROADCAST_GROUPS else frame
    hist = h.groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("__cum", F.sum("__c").over(w)).join(side(qt), "__g")
    chosen = hist.where((F.col("__cum") - F.col("__c") < F.col("quota")) & (F.col("quota") <= F.col("__cum"))) \
        .select("__g", F.col("__b").alias("__tb"), (F.col("quota") - (F.col("__cum") - F.col("__c"))).alias("__r"))
    cand = h.join(side(chosen), "__g").where(F.col("__b") == F.col("__tb"))
    wr = Window.partitionBy("__g").orderBy("__p", "__h")
    thr = cand.withColumn("__rn", F.row_number().over(wr)).where(F.col("__rn") == F.col("__r")) \
        .select("__g", F.col("__p").alias("__tp"), F.col("__h").alias("__th"))
    j = h.join(side(thr), "__g", "left")
    sel = (F.col("__p") < F.col("__tp")) | ((F.col("__p") == F.col("__tp")) & (F.col("__h") <= F.col("__th")))
    return j.select(*[q(c) for c in df.columns], F.coalesce(sel, F.lit(False)).alias(flag))


def n_test_rows(n: int, test_size: float) -> int:
    """Rows in the test side: ceil(n * test_size) (an int test_size is a count)."""
    if isinstance(test_size, int) and test_size >= 1:
        return int(test_size)
    return int(math.ceil(n * float(test_size)))


def split_random(df: DataFrame, id_cols: Sequence[str], test_size: float = 0.2,
                 seed: int = SEED, col: str = "split") -> DataFrame:
    """Exact random split: the ceil(n*test_size) rows first in hash order are
    ``test``, the rest ``train``."""
    n = df.count()
    k = n_test_rows(n, test_size)
    quotas = df.sparkSession.createDataFrame([(k,)], "quota bigint")
    out = select_first(df, shuffle_key(id_cols, seed), quotas)
    return out.select(*[q(c) for c in df.columns],
                      F.when(F.col("__sel"), "test").otherwise("train").alias(col))


def stratified_quotas(df: DataFrame, label: str, test_size: float = 0.2) -> DataFrame:
    """Per class ``n_c``, ``train_quota`` and ``quota`` (test rows).

    The train side is allotted by largest remainder (floor of n_train * share,
    leftover rows to the largest remainders, ties to the smaller class
    value); every other row of the class is test.
    """
    counts = df.groupBy(q(label).alias(label)).agg(F.count(F.lit(1)).alias("n_c"))
    tot = counts.agg(F.sum("n_c").alias("__n"))
    c = attach_one_row(counts, tot)
    n_test = F.ceil(F.col("__n") * F.lit(float(test_size))) if not (isinstance(test_size, int) and test_size >= 1) \
        else F.lit(test_size)
    c = c.withColumn("__ntr", F.col("__n") - n_test)
    c = c.withColumn("__cont", F.col("__ntr") * F.col("n_c") / F.col("__n")) \
        .withColumn("__fl", F.floor("__cont")).withColumn("__rem", F.col("__cont") - F.col("__fl"))
    # c has one row per class (a classification target: few rows), so these
    # un-keyed windows run over a bounded table, not over the data
    w_all = Window.partitionBy()
    c = c.withColumn("__need", F.col("__ntr") - F.sum("__fl").over(w_all))
    c = c.withColumn("__rk", F.row_number().over(Window.orderBy(F.desc("__rem"), q(label))))
    c = c.withColumn("train_quota", (F.col("__fl") + F.when(F.col("__rk") <= F.col("__need"), 1).otherwise(0))
                     .cast("bigint"))
    return c.select(q(label), "n_c", "train_quota", (F.col("n_c") - F.col("train_quota")).alias("quota"))


def split_stratified(df: DataFrame, id_cols: Sequence[str], label: str, test_size: float = 0.2,
                     seed: int = SEED, col: str = "split") -> DataFrame:
    """Stratified exact split: per class, its quota of rows first in hash order
    go to ``test``."""
    quotas = stratified_quotas(df, label, test_size).select(label, "quota")
    out = select_first(df, shuffle_key(id_cols, seed), quotas, [label])
    return out.select(*[q(c) for c in df.columns],
                      F.when(F.col("__sel"), "test").otherwise("train").alias(col))


def can_stratify(df: DataFrame, label: str, test_size: float = 0.2) -> DataFrame:
    """One row: whether a stratified split is possible (every class has >= 2
    rows and both sides hold at least one row per class) and the choice."""
    counts = df.groupBy(q(label)).agg(F.count(F.lit(1)).alias("n_c"))
    s = counts.agg(F.min("n_c").alias("min_class"), F.count(F.lit(1)).alias("n_classes"),
                   F.sum("n_c").alias("n_rows"))
    nt = F.ceil(F.col("n_rows") * F.lit(float(test_size)))
    ok = (F.col("min_class") >= 2) & (nt >= F.col("n_classes")) & (F.col("n_rows") - nt >= F.col("n_classes"))
    return s.select("n_rows", "n_classes", "min_class", nt.cast("bigint").alias("n_test"),
                    ok.alias("stratify"),
                    F.when(ok, "stratified").otherwise("random").alias("method"))


def split_auto(df: DataFrame, id_cols: Sequence[str], label: str, classification: bool,
               test_size: float = 0.2, seed: int = SEED, col: str = "split") -> DataFrame:
    """Stratified when the task is classification and stratifying is
    possible, otherwise random."""
    if classification and can_stratify(df, label, test_size).first()["stratify"]:
        return split_stratified(df, id_cols, label, test_size, seed, col)
    return split_random(df, id_cols, test_size, seed, col)


def cv_folds(df: DataFrame, id_cols: Sequence[str], label: str, k: int = 5, seed: int = SEED,
             col: str = "fold") -> DataFrame:
    """Stratified shuffled folds: per class, rows in hash order are dealt
    round-robin to folds 0..k-1."""
    keyed = df.withColumn("__hk", shuffle_key(id_cols, seed))
    pos = row_position(keyed, ["__hk"], [label])
    return pos.select(*[q(c) for c in df.columns], (F.col("__pos") % k).cast("int").alias(col))


def cv_folds_plain(df: DataFrame, order_by: Sequence[str], k: int = 5, col: str = "fold") -> DataFrame:
    """Contiguous folds in row order; the first n % k folds hold one extra row."""
    n = df.count()
    base, extra = divmod(n, k)
    pos = row_position(df, order_by)
    p = F.col("__pos")
    big = extra * (base + 1)
    fold = F.when(p < big, F.floor(p / (base + 1))).otherwise(
        F.lit(extra) + F.floor((p - big) / F.lit(max(base, 1))))
    return pos.select(*[q(c) for c in df.columns], fold.cast("int").alias(col))


def default_folds(n_rows: int, requested: int = 5) -> int:
    """Folds used by cross-validation: min(requested, n // 2); none for n <= 10."""
    if n_rows <= 10:
        return 0
    return min(requested, n_rows // 2)
