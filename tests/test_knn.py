"""k-NN search: block kernel, bounds and the whole search against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparkwright.operators import knn


def _brute_d2(Q, P, p=None):
    out = np.empty((len(Q), len(P)))
    for i, q in enumerate(Q):
        for j, x in enumerate(P):
            d = (np.asarray(q, float) - np.asarray(x, float)) ** 2
            if p is None:
                out[i, j] = d.sum()
            else:
                ok = ~np.isnan(d)
                out[i, j] = p / ok.sum() * d[ok].sum() if ok.any() else np.nan
    return out


def _brute(Q, need, P, n, t, k, p):
    D = _brute_d2(Q, P, p)
    out = []
    for i in range(len(Q)):
        order = sorted((j for j in range(len(P)) if not np.isnan(D[i, j]) and (need[i] < 0 or not np.isnan(P[j][need[i]]))),
                       key=lambda j: (D[i, j], t[j]))
        got, cum = [], 0
        for j in order:
            if cum >= k:
                break
            got.append((t[j], min(n[j], k - cum)))
            cum += n[j]
        out.append(got)
    return out


@pytest.mark.parametrize("p", [None, 3])
def test_block_kernel_matches_brute_force_with_multiplicity(p):
    rng = np.random.default_rng(7)
    Q, P = rng.integers(0, 4, size=(9, 3)).astype(float), rng.integers(0, 4, size=(12, 3)).astype(float)
    if p:
        Q[rng.random(Q.shape) < 0.3] = np.nan
        P[rng.random(P.shape) < 0.3] = np.nan
    n = rng.integers(1, 4, size=12)
    t = [f"t{j:02d}" for j in range(12)]
    need = np.array([-1, 0, 1, 2, -1, -1, 0, 0, 2]) if p else np.full(9, -1)
    got = knn.nearest(Q, need, P, n, t, 3, p)
    want = _brute(Q, need, P, n, t, 3, p)
    assert [[t[j] for a, j, _ in got if a == i] for i in range(9)] == [[name for name, _ in w] for w in want]


def _points(spark, P, n, t, carried=None):
    rows = [([None if np.isnan(v) else float(v) for v in x], int(c), name, None if carried is None else float(carried[j]))
            for j, (x, c, name) in enumerate(zip(P, n, t))]
    return spark.createDataFrame(rows, "x array<double>, n long, t string, carried double").repartition(3)


@pytest.mark.parametrize("p,rows", [(None, 8), (3, 8), (None, 1000), (3, 40)])
def test_search_matches_brute_force(spark, p, rows):
    """A third of the points on one line, null patterns, queries beyond all points; small and large cells."""
    rng = np.random.default_rng(11)
    P = rng.integers(-9, 10, size=(260, 3)).astype(float)
    P[:80, 1:] = 0.0
    Q = np.vstack([rng.integers(-9, 10, size=(50, 3)).astype(float), [[100.0, -100.0, 3.0]]])
    if p:
        P[rng.random(P.shape) < 0.25] = np.nan
        Q[rng.random(Q.shape) < 0.25] = np.nan
    P = np.array(list({tuple(map(str, x)): x for x in P}.values()))
    P = P[~np.isnan(P).all(axis=1)]
    n, t = rng.integers(1, 5, size=len(P)), [f"t{j * 7919 % 1000:03d}-{j}" for j in range(len(P))]
    need = rng.integers(-1, 3, size=len(Q)) if p else np.full(len(Q), -1)
    cells = knn.build_cells(_points(spark, P, n, t), 3, p, rows)
    assert sum(r["n"] for r in cells.table.select("n").collect()) == len(P)
    queries = spark.createDataFrame([(f"q{i}", [None if np.isnan(v) else float(v) for v in x], int(c))
                                     for i, (x, c) in enumerate(zip(Q, need))], "qk string, x array<double>, need int")
    got = knn.search(queries, cells, 3, 4).collect()
    for i, want in enumerate(_brute(Q, need, P, n, t, 4, p)):
        own = sorted((r for r in got if r["qk"] == f"q{i}"), key=lambda r: (r["d2"], r["t"]))
        assert [(r["t"], r["take"]) for r in own] == want


def test_bounds_hold_and_exclude_most_cells_of_clustered_points(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 8)) * 10
    P = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 8))
    Q = centres[rng.integers(0, 30, 100)] + rng.normal(size=(100, 8))
    cells = knn.build_cells(_points(spark, P, np.ones(3000), [str(j) for j in range(3000)]), 8, None, 64)
    bound = cells.bounds.least_d2(Q, np.full(100, -1))
    rows = {(r["part"], r["seq"]): np.frombuffer(r["points"]).reshape(-1, 8) for r in cells.table.collect()}
    D = [_brute_d2(Q, rows[c]).min(axis=1) for c in cells.bounds.ids]
    assert (bound <= np.array(D).T * (1 + 1e-9)).all()
    kth = np.sort(_brute_d2(Q, P), axis=1)[:, 4]
    assert (bound <= kth[:, None]).mean() < 0.5
    asked = spark.createDataFrame([(str(i), x.tolist(), -1, float(v)) for i, (x, v) in enumerate(zip(Q, kth))],
                                  "qk string, x array<double>, need int, d2 double")
    visits = sum(len(r["qks"]) for r in knn._ask(asked, cells, 8, False).collect())
    assert visits < 0.5 * len(Q) * len(cells.bounds.ids)


def test_points_without_structure_are_asked_by_group(spark, monkeypatch):
    """Every cell is visited, yet a query is sent once for each group of cells and gets its best points by group."""
    monkeypatch.setattr(knn, "GROUPS", 4, raising=False)
    rng = np.random.default_rng(4)
    P, Q = rng.normal(size=(600, 16)), rng.normal(size=(20, 16))
    t = [f"t{j:03d}" for j in range(600)]
    cells = knn.build_cells(_points(spark, P, np.ones(600, dtype=int), t), 16, None, 8)
    assert len(cells.bounds.ids) > 40
    queries = spark.createDataFrame([(f"q{i}", x.tolist(), -1) for i, x in enumerate(Q)],
                                    "qk string, x array<double>, need int").coalesce(1)
    asked = knn._ask(queries.withColumn("d2", F.lit(1e9)), cells, 16, False)
    sent = [name for r in asked.collect() for name in r["qks"]]
    assert set(sent) == {f"q{i}" for i in range(20)} and len(sent) <= 4 * 20
    got = knn.search(queries, cells, 16, 3).collect()
    for i, want in enumerate(_brute(Q, np.full(20, -1), P, np.ones(600, dtype=int), t, 3, None)):
        own = sorted((r for r in got if r["qk"] == f"q{i}"), key=lambda r: (r["d2"], r["t"]))
        assert [(r["t"], r["take"]) for r in own] == want


def test_classifier_votes(spark):
    """Two points of one place with different labels, repeated rows, ties of votes."""
    train = [([0.0, 0.0], 1.0)] * 3 + [([0.0, 0.0], 0.0)] * 3 + [([5.0, 5.0], 2.0)] * 4 + [([9.0, 9.0], 1.0)]
    df = spark.createDataFrame(train, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    model = knn.KNeighbors(6, cell_rows=2).fit(df)
    test = spark.createDataFrame([(1, [0.1, 0.0]), (2, [6.0, 6.0]), (3, [6.0, 6.0])], "id int, x array<double>") \
        .select("id", array_to_vector("x").alias("features"))
    got = {r["id"]: (r["prediction"], r["probability"].toArray().round(3).tolist()) for r in model.transform(test).collect()}
    assert got[1] == (0.0, [0.5, 0.5, 0.0])      # a tied vote goes to the smallest class
    assert got[2] == got[3] and got[2][0] == 2.0 and got[2][1][2] == pytest.approx(0.667)


def test_imputation_of_all_columns_at_once(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, size=(160, 4)).astype(float)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:3] = np.nan                                        # rows without any value take the means
    pdf = pd.DataFrame(x, columns=list("abcd")).astype(object).where(~np.isnan(x), None)
    rows = [(i, *r, 7) for i, r in enumerate(pdf.values.tolist())]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, whole int")
    got = {r["id"]: r for r in knn.impute_knn(df, columns=list("abcd"), k=3, cell_rows=16).collect()}
    keys = ["|".join("" if np.isnan(v) else str(v) for v in r) for r in x]
    import hashlib
    tie = [hashlib.md5(s.encode()).hexdigest() for s in keys]
    D = _brute_d2(x, x, 4)
    for i in range(160):
        assert got[i]["whole"] == 7
        for j, c in enumerate("abcd"):
            if not np.isnan(x[i, j]):
                assert got[i][c] == x[i, j]
                continue
            order = sorted((m for m in range(160) if not np.isnan(x[m, j]) and not np.isnan(D[i, m])), key=lambda m: (D[i, m], tie[m]))[:3]
            want = x[order, j].mean() if order else np.nanmean(x[:, j])
            assert got[i][c] == pytest.approx(want)
    assert knn.impute_knn(df.fillna(0.0), columns=list("abcd")).dtypes == df.dtypes
