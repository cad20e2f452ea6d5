import zlib

import numpy as np

from sparkwright.llm import mil

D = "/root/testdata/sf0.01"


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy(spark):
    docs, known = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    rows = mil.classify(docs, known).collect()
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in known.collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and np.mean([p == t for p, t in held]) >= 0.93
    assert np.mean([p == 1 for p, t in held if t == 1]) >= 0.97


def test_labels_of_the_held_out_fold_change_nothing(spark, sample):
    known = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
    turned = [(r["doc_id"], 1 - r["quality"] if held(r) else r["quality"], 0, "") for r in known]
    plain = [(r["doc_id"], r["quality"], 0, "") for r in known]
    a, b = (sorted(mil.classify(sample, labels(spark, x)).collect()) for x in (plain, turned))
    assert a == b


def test_odd_rows(spark, odd):
    for rows in ([], [(1, 1, 0, "")], [(1, 1, 0, ""), (3, 0, 0, None), (6, None, 0, ""), (None, 0, 0, ""), (11, 0, 1, "x"),
                                      (2, 1, 0, ""), (2, 0, 0, "")]):
        out = mil.classify(odd, labels(spark, rows)).collect()
        assert sorted((r["doc_id"] for r in out), key=str) == sorted((r["doc_id"] for r in odd.collect()), key=str)
        assert all(0 <= r["score"] <= 1 for r in out)
        assert [r["held_out"] for r in out if r["doc_id"] is None] == [True]
    assert mil.classify(odd.limit(0), labels(spark)).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, mil.WIDTH)) for n in (1, 3, 2)]
    model = mil.train([b.astype(np.float32) for b in bags], np.array([1, 1, 1]))
    model.w = {k: rng.normal(0, 0.3, v.shape) for k, v in model.w.items()}
    x, starts, y = np.concatenate(bags), np.array([0, 1, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, starts)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    for name, g in mil._gradients(model, x, starts, y).items():
        flat = model.w[name].reshape(-1)
        for k in rng.choice(len(flat), min(4, len(flat)), replace=False):
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-5 - g.reshape(-1)[k]) < 1e-6, name


def test_training_passages_are_bounded(spark, sample):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = sample.select("doc_id", "text")
    whole, _ = mil._training_bags(docs, labels, 100, 10 ** 6)
    few, y = mil._training_bags(docs, labels, 100, 40)
    assert sum(map(len, whole)) > 40 >= sum(map(len, few)) > 0 and len(few) == len(y)
    assert mil._training_bags(docs, labels, 100, 0)[0] == []
