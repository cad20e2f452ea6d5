"""Operator 3: quality rules with an isolation forest over rule statistics.

Every text gets simple statistics (words, symbols, repeated lines, repeated
three-word windows).  Fixed rules reject the clear cases.  An isolation forest
over ratios of these statistics finds the odd ones: trees split random
features at random values, and a document that few splits isolate has a short
mean path and a score near 1.  The threshold on the score comes from labelled
rows.

Scale: one scan for the statistics, which are checkpointed (a few numbers per
document); each of ``TREES`` trees grows on ``SAMPLE`` rows with the smallest
hashes among all rows, so the forest's size is fixed; scoring is a second,
narrow pass.  Labels meet the statistics in a shuffle join, and calibration
reads counts per score step only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.llm.common import prepared, text_bytes

TREES = 100
SAMPLE = 256                  # rows per tree
STEPS = 1000                  # score steps of the calibration
KEEP_GOOD = 0.98              # share of good labelled rows that the threshold has to keep
GOOD_WEIGHT = 5               # a good row lost weighs as much as so many bad ones kept

STATS = T.StructType([T.StructField(c, T.LongType()) for c in (
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars")])
_SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
_SPACES = b" \t\n\x0b\x0c\r"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that the text holds twice or more."""
    m = len(words) - size + 1
    if m < 2:
        return 0
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    grams = np.zeros(m, dtype=np.uint64)
    for k in range(size):
        grams = grams * _MIX + codes[k:k + m]
    _, group, counts = np.unique(grams, return_inverse=True, return_counts=True)
    again = (counts > 1)[group]
    covered = np.zeros(len(words), dtype=bool)
    for k in range(size):
        covered[k:k + m] |= again
    return int(covered.sum())


def statistics_of(text: str | None) -> tuple[int, ...]:
    """The statistics of one text, in the order of ``STATS`` after the id."""
    raw = text_bytes(text)
    words = raw.split()
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line.strip(_SPACES):
            dup += line in seen
            seen.add(line)
    codes = np.frombuffer(raw, dtype=np.uint8)
    spaces = int(np.count_nonzero((codes == 32) | ((codes >= 9) & (codes <= 13))))
    starts = int(np.count_nonzero((codes & 0xC0) != 0x80))  # code points
    return len(words), starts - spaces, sum(map(raw.count, _SYMBOLS)), dup, repeat_words(words), starts


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of whole-text statistics per document row (null text: all zero)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics_of(t.as_py()) for t in batch.column(1)], dtype=np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(stats[:, k]) for k in range(6))],
                                             names=STATS.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(rows, STATS)


def feature_columns() -> list:
    """Ratios of the statistics, each defined for empty texts too."""
    def per(top, bottom):
        return F.col(top).cast("double") / F.greatest(F.col(bottom), F.lit(1))
    return [per("n_symbols", "n_chars").alias("symbol_share"), per("n_symbols", "n_words").alias("word_symbols"),
            per("word_chars", "n_words").alias("mean_word"), per("n_repeat_words", "n_words").alias("repeat_share"),
            per("n_dup_lines", "n_words").alias("dup_lines"), F.log1p(F.col("n_chars").cast("double")).alias("log_chars")]


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1),
                    np.where(n == 2, 1.0, 0.0))


class IsolationTree:
    """Random splits down to single points or ``depth``; nodes are rows of flat arrays."""

    def __init__(self, x: np.ndarray, rng: np.random.Generator, depth: int):
        self.feature, self.value, self.child, self.path = [], [], [], []
        self._grow(x, rng, 0, depth)
        self.feature, self.child = np.array(self.feature), np.array(self.child)
        self.value, self.path = np.array(self.value), np.array(self.path)

    def _grow(self, x: np.ndarray, rng: np.random.Generator, at: int, depth: int) -> int:
        node = len(self.feature)
        self.feature.append(-1)
        self.value.append(0.0)
        self.child.append((node, node))
        self.path.append(at + float(_mean_path(np.array(len(x)))))
        spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else []
        if at < depth and len(spread):
            f = int(rng.choice(spread))
            v = float(rng.uniform(x[:, f].min(), x[:, f].max()))
            left = x[:, f] <= v
            self.feature[node], self.value[node] = f, v
            self.child[node] = self._grow(x[left], rng, at + 1, depth), self._grow(x[~left], rng, at + 1, depth)
        return node

    def lengths(self, x: np.ndarray, depth: int) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(depth):
            f = self.feature[node]
            right = x[rows, np.maximum(f, 0)] > self.value[node]
            node = np.where(f < 0, node, self.child[node, right.astype(np.int64)])
        return self.path[node]


class IsolationForest:
    """Trees over equal slices of a fixed-size sample; scores lie in (0, 1)."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, size: int = SAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = max(2, min(size, len(sample)))
        self.depth = int(np.ceil(np.log2(self.size)))
        self.trees = [IsolationTree(sample[rng.permutation(len(sample))[:self.size]], rng, self.depth)
                      for _ in range(trees)] if len(sample) else []

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.trees or not len(x):
            return np.full(len(x), 0.5)
        mean = sum(t.lengths(x, self.depth) for t in self.trees) / len(self.trees)
        return 2.0 ** (-mean / max(float(_mean_path(np.array(self.size))), 1e-9))


def _calibrate(scored: DataFrame, labels: DataFrame) -> float:
    """The score step with the most bad rows rejected, less ``GOOD_WEIGHT`` times the good ones (as
    shares), among those that keep ``KEEP_GOOD`` of the good rows.

    1 (no rejection) without labels of both kinds, or where no step gains anything.
    """
    counts = scored.join(labels, "doc_id").groupBy(F.floor(F.col("score") * STEPS).cast("int").alias("step")) \
        .agg(F.sum((F.col("quality") == 1).cast("long")).alias("good"),
             F.sum((F.col("quality") == 0).cast("long")).alias("bad")).collect()  # at most STEPS + 1 rows
    good, bad = np.zeros(STEPS + 2), np.zeros(STEPS + 2)
    for r in counts:
        good[r["step"]], bad[r["step"]] = r["good"] or 0, r["bad"] or 0
    if not good.sum() or not bad.sum():
        return 1.0
    lost = good[::-1].cumsum()[::-1] / good.sum()
    caught = bad[::-1].cumsum()[::-1] / bad.sum()
    gain = np.where(lost <= 1 - KEEP_GOOD, caught - GOOD_WEIGHT * lost, -1.0)
    return float(gain.argmax()) / STEPS if gain.max() > 0 else 1.0


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Rule statistics and verdicts of whole texts, one row per document row.

    ``base_failed``: fewer than 50 words, or over half of the words inside
    repeated three-word windows.  ``kept``: not ``base_failed`` and an anomaly
    ``score`` below the calibrated ``threshold``.

    A null or empty text has no words and fails; null ids and repeated rows are
    judged like any other (labels join on equal, non-null ids, repeated labels
    count as often as they occur, null labels never); empty tables give no rows,
    and empty labels reject nothing beyond the rules.  Extra columns are ignored.
    """
    spark = prepared(docs).sparkSession
    stats = rule_statistics(docs, id_col, text_col).checkpoint(eager=True)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    own = feature_columns()
    # the forest's sample: rows with the smallest hashes among all that pass the rules, of a fixed number;
    # only a hashed share of about four times as many is sorted, so what tasks send does not grow with them
    passed = stats.where(~F.col("base_failed")).withColumn("hash", F.pmod(F.xxhash64(*STATS.names), F.lit(1 << 40)))
    share = min(1.0, 4.0 * trees * sample / max(passed.count(), 1))
    rows = passed.where(F.col("hash") < int(share * (1 << 40))).orderBy("hash", "doc_id").limit(trees * sample) \
        .select(*own).collect()
    forest = IsolationForest(np.array([tuple(r) for r in rows], dtype=np.float64).reshape(-1, len(own)),
                             trees, sample)
    shared = spark.sparkContext.broadcast(forest)  # bounded by trees * sample nodes

    @F.pandas_udf("double")
    def anomaly(x):
        import pandas as pd
        return pd.Series(shared.value.scores(x.to_numpy(dtype=np.float64)))

    scored = stats.withColumn("score", anomaly(F.struct(*own)))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("quality"))
    threshold = _calibrate(scored.where(~F.col("base_failed")).select("doc_id", "score"), known)
    return scored.withColumn("threshold", F.lit(threshold)) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") < F.col("threshold")))
