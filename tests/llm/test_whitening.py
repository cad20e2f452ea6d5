import math

import numpy as np
import pytest

from sparkwright.llm import whitening as wh


def brute(rows):
    """Whitening by plain integer loops over the rows (id, vector)."""
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in fine), default=0)
    fine = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in fine if len(v) == d and d]
    n = len(fine)
    if not n:
        return None
    s = [sum(x[j] for _, x in fine) for j in range(d)]
    dev = [sum((n * x[j] - s[j]) ** 2 for j in range(d)) for _, x in fine]
    y = np.array([[(n * x[j] - s[j]) / n for j in range(d)] for _, x in fine])
    return fine, n, s, dev, y, y.T @ y / n


@pytest.mark.parametrize("spread", [1, 40, 2 ** 40, 2 ** 62])
def test_cross_products_are_exact(spread):
    rng = np.random.default_rng(spread % 1000)
    x = rng.integers(-spread, spread, size=(777, 5), dtype=np.int64)
    x[:, 3] = 17                                          # a constant dimension has no planes
    n, sums, products = wh.cross_products(x)
    big = x.astype(object)
    assert n == 777 and list(sums) == list(big.sum(axis=0)) and (products == big.T @ big).all()


def test_planes_hold_the_bits():
    y = np.array([[5, 0], [2, 1], [7, 0]], dtype=np.uint64)
    planes, bits = wh.bit_planes(y)
    assert bits.tolist() == [3, 1]
    assert np.bitwise_count(planes).sum(axis=1).tolist() == [2, 2, 2, 1]


def check(spark, rows, got, k=8):
    fine, n, s, dev, y, cov = brute(rows)
    values, vectors = np.linalg.eigh(cov)
    k = min(k, len(cov))
    assert len(got) == k * n and {r["n"] for r in got} == {n}
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], []).append(r)
    for c in range(k):
        e, v = values[-1 - c], vectors[:, -1 - c]
        if e < 1e-9 * values[-1] or any(abs(e - o) < 1e-9 * values[-1] for o in np.delete(values, len(values) - 1 - c)):
            continue
        want = y @ v / math.sqrt(e)
        have = {r["vec_id"]: r for r in got if r["component"] == c + 1}
        sign = np.sign(sum(have[i]["whitened"] * w for (i, _), w in zip(fine, want)))
        for (i, _), w, dd in zip(fine, want, dev):
            assert have[i]["whitened"] == pytest.approx(sign * w, abs=1e-7)
            assert have[i]["explained"] == pytest.approx(e / np.trace(cov), rel=1e-9) and have[i]["deviation"] == dd
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-6


def test_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(12, 12))
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=12) @ mix]) for i in range(400)]
    rows += [(1000, None), (1001, [1.0] * 11 + [None]), (1002, [math.nan] * 12), (1003, [math.inf] * 12),
             (1004, []), (1005, [1.0] * 5), (1006, [0.0] * 12), (1007, [-0.0] * 12)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, component string, n int")
    for parts, block in ((1, 100), (7, 32_768)):
        check(spark, rows, wh.whiten(df.repartition(parts), block_rows=block).collect())


def test_sample_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    check(spark, rows, wh.whiten(df).collect())


def test_sums_beyond_64_bits(spark):
    rows = [(i, [float(2.0 ** 50 * (i % 7)), float(-(2.0 ** 49) * (i % 3)), 0.5 * i]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = wh.whiten(df).collect()
    fine, n, s, dev, _, _ = brute(rows)
    model = wh.fit(df)
    assert model.n == n and list(model.sums) == s
    want = {i: d if d <= 2 ** 63 - 1 else None for (i, _), d in zip(fine, dev)}
    assert {r["vec_id"]: r["deviation"] for r in got} == want and None in want.values()


def test_bands_of_few_entries(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=9).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = wh.scatter(df)
    monkeypatch.setattr(wh, "BAND_ENTRIES", 20)
    assert wh.scatter(df) == want and want[:2] == (9, 60)


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert wh.whiten(spark.createDataFrame([], schema)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = wh.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect()
    assert sorted((r["component"], r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in one) == \
        [(1, 0.0, 0.0, 0, 0.0)] * 2 + [(2, 0.0, 0.0, 0, 0.0)] * 2
    flat = wh.whiten(spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (2, [2.0, 5.0])], schema)).collect()
    assert {r["whitened"] for r in flat if r["component"] == 2} == {0.0} and len(flat) == 6
    huge = wh.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0])], schema)).collect()
    assert len(huge) == 4 and all(math.isfinite(r["whitened"]) for r in huge)
