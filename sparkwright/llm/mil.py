"""Operator 8: quality classifier by attention-based multiple-instance learning.

A document is a bag of passages, and only the document has a label.  Every
passage is encoded (hashed words and word shapes, a few ratios, one learned
tanh layer); gated attention gives each passage a weight; the weighted sum of
the encodings is scored by a logistic unit.  All parameters are learned
together by gradient descent on the labels of whole documents.

Scale: training uses at most ``TRAIN_DOCS`` labelled documents (those with the
smallest id hashes) and at most ``TRAIN_PASSAGES`` passages of them, documented
bounds, so the model and what reaches the driver have a fixed size; a document that
would exceed the second bound is left out whole, and the next one is asked.  Scoring is one scan of the documents without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.llm.common import prepared, text_bytes

PASSAGE = 64                  # words
WORD_SLOTS, SHAPE_SLOTS, RATIOS = 192, 64, 7
WIDTH = WORD_SLOTS + SHAPE_SLOTS + RATIOS
TRAIN_DOCS = 2500
TRAIN_PASSAGES = 150_000       # of these documents, about 160 MB as float32 on the driver
HIDDEN, ATTENTION, EPOCHS, RATE, DECAY = 24, 12, 120, 0.02, 1e-3
FOLDS, THRESHOLD = 5, 0.3
_MEMO = 100_000                # words kept per worker; the memo starts anew beyond that

SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
_PASSAGES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.BinaryType())])
# the shape of a word: letters, capitals and digits become one sign each, other signs stay
_SHAPE = bytes(ord("a") if 97 <= b <= 122 or b > 127 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57
               else b for b in range(256))


class _Slots(dict):
    """Word -> its columns as one number: the lower-cased word's, times SHAPE_SLOTS, plus its shape's."""

    def __missing__(self, word: bytes) -> int:
        shape = word.translate(_SHAPE)
        slots = zlib.crc32(word.lower()) % WORD_SLOTS * SHAPE_SLOTS + zlib.crc32(shape[:1] + shape[-3:]) % SHAPE_SLOTS
        if len(self) > _MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = slots
        return slots


_slots = _Slots()


def passages(text: str | None) -> np.ndarray:
    """One feature row per passage of a whole text; a text without words is one passage."""
    words = text_bytes(text).split()
    n = max(1, -(-len(words) // PASSAGE))
    x = np.zeros((n, WIDTH), dtype=np.float32)
    if not words:
        return x
    slots = np.fromiter(map(_slots.__getitem__, words), dtype=np.int64, count=len(words))
    at = np.arange(len(words)) // PASSAGE
    size = np.bincount(at, minlength=n).astype(np.float32)[:, None]
    word, shape = np.divmod(slots, SHAPE_SLOTS)
    at *= WIDTH
    x += np.bincount(np.concatenate([at + word, at + (shape + WORD_SLOTS)]), minlength=n * WIDTH).reshape(n, WIDTH)
    x = np.sqrt(x / size)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    edge = np.concatenate([[0], ends[PASSAGE - 1::PASSAGE], ends[-1:]])[:n + 1]
    total = np.maximum(np.diff(edge), 1)
    kinds = ((raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57), raw > 127,
             (raw < 48) | ((raw > 57) & (raw < 65)) | ((raw > 90) & (raw < 97)) | ((raw > 122) & (raw < 128)))
    for k, kind in enumerate(kinds):
        x[:, WORD_SLOTS + SHAPE_SLOTS + k] = np.add.reduceat(kind, edge[:-1], dtype=np.int64) / total
    again = np.concatenate([[False], slots[1:] == slots[:-1]])
    x[:, -3] = np.add.reduceat(again, np.arange(0, len(words), PASSAGE), dtype=np.int64) / size[:, 0]
    x[:, -2] = total / size[:, 0] / 10
    x[:, -1] = np.log1p(size[:, 0]) / 5
    return x


@dataclass
class Model:
    """Parameters; ``w`` maps names to arrays."""
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """All steps for bags that begin at ``starts`` among the passages ``x`` (standardised)."""
        w = self.w
        sizes = np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ w["enc"] + w["enc_b"])
        v, u = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        e = (v * u) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        att = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(att[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out_b"], -30, 30)))
        return {"sizes": sizes, "h": h, "v": v, "u": u, "att": att, "z": z, "p": p}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        starts = np.cumsum([0, *map(len, bags[:-1])])
        return self.forward((np.concatenate(bags) - self.mean) / self.scale, starts)["p"]


def _gradients(m: Model, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss."""
    w, f = m.w, m.forward(x, starts)
    d = (f["p"] - y) / len(y)
    g = {"out": f["z"].T @ d, "out_b": d.sum(keepdims=True)}
    dz = np.repeat(d, f["sizes"])[:, None] * w["out"]
    datt = (dz * f["h"]).sum(axis=1)
    de = f["att"] * (datt - np.repeat(np.add.reduceat(f["att"] * datt, starts), f["sizes"]))
    g["a"] = (f["v"] * f["u"]).T @ de
    dvu = de[:, None] * w["a"]
    dv, du = dvu * f["u"] * (1 - f["v"] ** 2), dvu * f["v"] * f["u"] * (1 - f["u"])
    g["v"], g["u"] = f["h"].T @ dv, f["h"].T @ du
    dh = (f["att"][:, None] * dz + dv @ w["v"].T + du @ w["u"].T) * (1 - f["h"] ** 2)
    g["enc"], g["enc_b"] = x.T @ dh, dh.sum(axis=0)
    return g


def train(bags: list[np.ndarray], y: np.ndarray, seed: int = 11) -> Model:
    """Fit by full-batch Adam; without labels of both kinds the model is constant."""
    rng = np.random.default_rng(seed)
    w = {"enc": rng.normal(0, WIDTH ** -0.5, (WIDTH, HIDDEN)), "enc_b": np.zeros(HIDDEN),
         "v": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, ATTENTION)), "u": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, ATTENTION)),
         "a": rng.normal(0, ATTENTION ** -0.5, ATTENTION), "out": np.zeros(HIDDEN), "out_b": np.zeros(1)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    good = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    w["out_b"][:] = np.log(good / (1 - good))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), w)
    x = np.concatenate(bags)
    mean, scale = x.mean(axis=0), x.std(axis=0) + np.float32(0.02)
    x = (x - mean) / scale
    starts, y = np.cumsum([0, *map(len, bags[:-1])]), y.astype(np.float32)
    model = Model(mean, scale, w)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, EPOCHS + 1):
        for k, g in _gradients(model, x, starts, y).items():
            g = g + DECAY * w[k] * (k not in ("enc_b", "out_b"))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            rate = RATE * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            w[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return model


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo the folds; fold 0 is held out (a null id too)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


def _training_bags(docs: DataFrame, labels: DataFrame, train_docs: int,
                   train_passages: int) -> tuple[list[np.ndarray], np.ndarray]:
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg(F.max("quality").cast("int").alias("quality")).where(fold(F.col("doc_id")) != 0)
    # at most train_docs rows of two numbers
    chosen = {r["doc_id"]: r["quality"] for r in
              known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).collect()}
    if not chosen:
        return [], np.zeros(0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([passages(t.as_py()).astype("<f2").tobytes() for t in batch.column(1)],
                                          pa.binary())], names=_PASSAGES.names)

    names = docs.sparkSession.createDataFrame([(i,) for i in sorted(chosen)], "doc_id long")
    found = docs.join(F.broadcast(names), "doc_id", "left_semi").dropDuplicates(["doc_id"]) \
        .select("doc_id", "text").mapInArrow(rows, _PASSAGES).checkpoint(eager=True)
    sizes = {r["doc_id"]: r["n"] // (2 * WIDTH) for r in found.select("doc_id", F.octet_length("x").alias("n")).collect()}
    taken, held = [], 0
    for i in chosen:             # in the order of the hashes
        if i in sizes and held + sizes[i] <= train_passages:
            taken.append((i,))
            held += sizes[i]
    names = docs.sparkSession.createDataFrame(taken, "doc_id long")
    found = sorted((r["doc_id"], r["x"]) for r in found.join(F.broadcast(names), "doc_id", "left_semi").collect())
    bags = [np.frombuffer(x, "<f2").reshape(-1, WIDTH).astype(np.float32) for _, x in found]
    return bags, np.array([chosen[i] for i, _ in found])


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             train_docs: int = TRAIN_DOCS, train_passages: int = TRAIN_PASSAGES, threshold: float = THRESHOLD) -> DataFrame:
    """Quality of whole texts; one row per document row: doc_id, held_out, score, predicted.

    ``score`` (0 to 1) is the chance that the label is 1, from the text alone;
    ``predicted`` is 1 from ``threshold`` on.  Labels are learned from folds 1
    to 4 only; ``held_out`` marks fold 0.

    A null or empty text is one empty passage and gets a score; null ids are held
    out; repeated rows get the same score each (training takes one of them); an
    id with several labels counts with the larger one.  Without usable labels of
    both kinds the score is the same for all; an empty table gives no rows;
    extra columns are ignored.
    """
    own = prepared(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    model = _broadcast_model(own, labels, train_docs, train_passages)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_batch_scores(model.value, batch.column(1)))],
                                             names=SCORES.names)

    return own.mapInArrow(rows, SCORES).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
              train_docs: int = TRAIN_DOCS, train_passages: int = TRAIN_PASSAGES, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches ``threshold`` (see ``classify``).

    Null and empty texts are scored like any other; null ids and repeated rows are judged row by row; an empty
    table gives no rows.
    """
    own = prepared(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    model = _broadcast_model(own, labels, train_docs, train_passages)
    at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_batch_scores(model.value, batch.column(at)) >= threshold))

    return docs.mapInArrow(rows, docs.schema)


def _broadcast_model(own: DataFrame, labels: DataFrame, train_docs: int, train_passages: int):
    """The trained model, broadcast (it has a fixed number of parameters)."""
    return own.sparkSession.sparkContext.broadcast(train(*_training_bags(own, labels, train_docs, train_passages)))


def _batch_scores(model: Model, texts: pa.Array) -> np.ndarray:
    out, bags, held = [], [], 0
    for text in texts:
        bags.append(passages(text.as_py()))
        held += len(bags[-1])
        if held > 4096:
            out.append(model.scores(bags))
            bags, held = [], 0
    out.append(model.scores(bags))
    return np.concatenate(out).astype(np.float64)
