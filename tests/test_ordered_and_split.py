"""Blockwise ordered scans and exact splits against brute force, on a
fixture where one key holds a third of the rows and blocks are tiny."""

import math
import random

import numpy as np
import pandas as pd
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sparkwright.operators import ordered, split as SP


def _fixture(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if i % 3 == 0 else rng.randint(1, 20)       # key 0 holds a third of rows
        v = None if rng.random() < 0.4 else round(rng.random() * 100, 3)
        rows.append((i, key, v))
    return spark.createDataFrame(rows, "id bigint, k bigint, v double"), pd.DataFrame(rows, columns=["id", "k", "v"])


def _by_id(df):
    return {r["id"]: r["v"] for r in df.collect()}


def test_ffill_bfill_interpolate_match_pandas(spark):
    sdf, pdf = _fixture(spark)
    pdf = pdf.sort_values("id")
    exp_f = pdf.groupby("k")["v"].ffill()
    exp_b = pdf.groupby("k")["v"].bfill()
    exp_i = pdf.groupby("k")["v"].transform(lambda s: s.reset_index(drop=True).interpolate().values)
    got_f = _by_id(ordered.ffill(sdf, "v", ["id"], ["k"], n_blocks=7))
    got_b = _by_id(ordered.bfill(sdf, "v", ["id"], ["k"], n_blocks=7))
    got_i = _by_id(ordered.interpolate_linear(sdf, "v", ["id"], ["k"], n_blocks=7))
    for i, idx in zip(pdf["id"], pdf.index):
        for exp, got in ((exp_f, got_f), (exp_b, got_b), (exp_i, got_i)):
            e = exp.loc[idx]
            g = got[i]
            if pd.isna(e):
                assert g is None
            else:
                assert abs(g - e) < 1e-9


def test_global_ffill_without_key(spark):
    sdf, pdf = _fixture(spark)
    exp = pdf.sort_values("id")["v"].ffill()
    got = _by_id(ordered.ffill(sdf, "v", ["id"], n_blocks=5))
    for i, e in zip(pdf.sort_values("id")["id"], exp):
        assert (got[i] is None) if pd.isna(e) else abs(got[i] - e) < 1e-12


def test_row_position_and_cumsum(spark):
    sdf, pdf = _fixture(spark)
    pos = {r["id"]: r["__pos"] for r in ordered.row_position(sdf, ["id"], ["k"], n_blocks=6).collect()}
    exp = pdf.sort_values("id").groupby("k").cumcount()
    for idx, p in exp.items():
        assert pos[pdf.loc[idx, "id"]] == p
    cs = ordered.cumulative_sum(sdf.fillna(0.0), ["v"], ["id"], ["k"], n_blocks=6)
    got = {r["id"]: r["cum_v"] for r in cs.collect()}
    exp2 = pdf.fillna(0.0).sort_values("id").groupby("k")["v"].cumsum()
    for idx, e in exp2.items():
        assert abs(got[pdf.loc[idx, "id"]] - e) < 1e-6


def test_stratified_split_exact_quotas(spark):
    sdf, pdf = _fixture(spark)
    out = SP.split_stratified(sdf, ["id"], "k", 0.2).toPandas()
    n_test = math.ceil(len(pdf) * 0.2)
    assert (out["split"] == "test").sum() == n_test
    # every class keeps at least its floor share on the train side
    for k, g in out.groupby("k"):
        assert (g["split"] == "train").sum() >= math.floor((len(pdf) - n_test) * len(g) / len(pdf))


@settings(max_examples=8, deadline=None)
@given(n=st.integers(min_value=1, max_value=300), frac=st.sampled_from([0.1, 0.2, 0.25, 0.5]))
def test_random_split_is_exact_partition(spark, n, frac):
    df = spark.range(n).withColumnRenamed("id", "rid")
    out = SP.split_random(df, ["rid"], frac).toPandas()
    assert len(out) == n
    assert (out["split"] == "test").sum() == math.ceil(n * frac)
    # the test side is exactly the first rows in md5 order
    import hashlib
    order = sorted(range(n), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    assert set(out[out["split"] == "test"]["rid"]) == set(order[:math.ceil(n * frac)])


def test_plain_folds_sizes(spark):
    df = spark.range(23).withColumnRenamed("id", "rid")
    out = SP.cv_folds_plain(df, ["rid"], 5).toPandas()
    sizes = out.groupby("fold").size().sort_index().tolist()
    assert sizes == [5, 5, 5, 4, 4]
    assert np.all(np.diff(out.sort_values("rid")["fold"].values) >= 0)


def test_blocks_follow_the_rows_and_plans_do_not(spark, monkeypatch):
    """More rows give more blocks; the plan that assigns them stays the same size however many there are."""
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 1000)
    counts, sizes = [], []
    for n in (2_000, 20_000, 200_000):
        blocks = ordered._n_blocks(spark.range(n), None)
        out = ordered.assign_blocks(spark.range(n).withColumn("s", F.hash("id")), [F.col("s"), F.col("id")], blocks)
        counts.append(out.select("__blk").distinct().count())
        sizes.append(len(out._jdf.queryExecution().analyzed().toString()))
    assert counts[0] < counts[1] < counts[2] and counts[2] >= 150 and max(sizes) < 2 * min(sizes)


def test_bounds_of_long_texts_and_equal_beginnings(spark):
    """Texts that agree in their first characters share a block; positions are right all the same."""
    head = "x" * (ordered.CUT_CHARS + 3)
    rows = [(head + str(i % 50), i) for i in range(900)] + [(None, -i) for i in range(300)] + [("a" * (i % 40), 1000 + i) for i in range(500)]
    df = spark.createDataFrame(rows, "t string, i long").repartition(4)
    got = {r["i"]: r["__pos"] for r in ordered.row_position(df, ["t", "i"], n_blocks=9).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert got == {i: p for p, (_, i) in enumerate(want)}
    assert ordered._cut_keys(df, [F.col("t"), F.col("i")]).__len__() == 1
