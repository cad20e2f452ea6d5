import re
from collections import Counter

import numpy as np

from sparkwright.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    counts = Counter(grams)
    rep = {k + d for k, g in enumerate(grams) if counts[g] > 1 for d in range(3)}
    failed = len(words) < 50 or 100 * len(rep) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), failed


COLS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, score double")


def test_statistics_match_brute_force(spark, odd, sample):
    for docs in (odd, sample):
        got = q.judge(docs, labels(spark)).collect()
        want = sorted(((r["doc_id"], *brute(r["text"])) for r in docs.collect()), key=str)
        assert sorted((tuple(r[c] for c in COLS) for r in got), key=str) == want
        assert all(r["kept"] == (not r["base_failed"]) for r in got)  # no labels: the rules alone


def test_empty(spark):
    assert q.judge(spark.createDataFrame([], "doc_id long, text string"), labels(spark)).count() == 0


def test_forest_isolates_the_odd_points():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 4))
    x[:20] += 9
    scores = q.IsolationForest(x[rng.permutation(5000)[:4096]]).scores(x)
    assert scores[:20].min() > np.quantile(scores[20:], 0.99) and 0 < scores.min() and scores.max() < 1
    same = q.IsolationForest(np.ones((10, 2))).scores(np.ones((3, 2)))
    assert len(set(same)) == 1


def test_calibrated_verdicts_keep_good_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = q.judge(docs, known).where("NOT base_failed").join(known, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in out}
    assert n.get((1, False), 0) <= 0.02 * n[(1, True)]
    assert n[(0, False)] > n.get((0, True), 0)
