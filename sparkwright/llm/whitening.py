"""Operator 12: whitening of embeddings from exact integer cross-products.

Entries become integers (``floor(scale * c) + offset``).  A task takes blocks of
rows, subtracts each dimension's smallest value, and packs every bit plane of
every dimension across the rows into 64-bit words.  The cross-product of two
dimensions is then the sum over their planes k and l of ``2^(k+l)`` times the
number of rows with both bits set: an AND and a popcount over words.  The shift is
undone in Python integers, so counts, sums and cross-products are exact at any size
and in any order of merging.  Centring is exact too (``n * Q_ij - S_i * S_j``);
only the finished covariance becomes double, before ``eigh``.

Scale: rows never move.  A task sends one partial (d + d^2 integers, in bands), which
are merged by slot and then by band, and the driver gets d + d^2 integers, which
depends on the dimensions alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import prepared

SCALE, OFFSET = 1024, 100_000
BLOCK_ROWS = 32_768               # rows of one set of bit planes
SLOTS, BAND_ENTRIES = 1024, 8192  # partials merge by slot first; a partial travels in bands of so many integers
PARTIAL_SCHEMA = "dims int, band int, slot int, n long, entries array<string>"
LONG_MAX = 2 ** 63 - 1
_EXACT = 2 ** 62                  # products below it fit 64-bit integers


# ------------------------------------------------------------------ integers of a batch
def finite_vectors(column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Rows of a list column without nulls or non-finite entries, by length.

    Returns the kept row numbers and, per vector length, (row numbers, matrix).
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = np.asarray(column.is_valid())
    lengths = np.where(there, np.asarray(column.value_lengths().fill_null(0)), -1)
    out = {}
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        values = column.take(pa.array(rows)).flatten()
        matrix = np.asarray(values.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(rows), int(d))
        fine = np.isfinite(matrix).all(axis=1)
        if fine.any():
            out[int(d)] = (rows[fine], matrix[fine])
    kept = np.sort(np.concatenate([r for r, _ in out.values()])) if out else np.zeros(0, dtype=np.int64)
    return kept, out


def as_integers(matrix: np.ndarray, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    """``floor(scale * c) + offset`` as 64-bit integers; values beyond their range become its ends."""
    with np.errstate(over="ignore"):
        low = np.floor(matrix * scale)
    if np.abs(low).max(initial=0.0) < 2.0 ** 62:
        return low.astype(np.int64) + offset
    exact = [min(max(int(v) + offset, -LONG_MAX - 1), LONG_MAX) if math.isfinite(v) else
             (LONG_MAX if v > 0 else -LONG_MAX - 1) for v in low.ravel().tolist()]
    return np.array(exact, dtype=np.int64).reshape(low.shape)


# ------------------------------------------------------------------ bit-sliced products
def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Planes of non-negative integers (rows x dims, uint64), packed across rows.

    Returns the words, one row per plane, and the number of planes per dimension.
    """
    rows, dims = y.shape
    bits = np.array([int(v).bit_length() for v in y.max(axis=0)], dtype=np.int64)
    words = -(-rows // 64)
    planes = np.zeros((int(bits.sum()), words * 8), dtype=np.uint8)
    at = 0
    for j in range(dims):
        for k in range(bits[j]):
            bit = ((y[:, j] >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(bit)
            planes[at, :len(packed)] = packed
            at += 1
    return planes.view(np.uint64), bits


def cross_products(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, sums and cross-products of integer rows, as exact Python integers.

    One plane at a time meets the planes of its own and all later dimensions, and
    its counts are weighted at once, so nothing grows with the square of the planes.
    """
    rows, dims = x.shape
    base = x.min(axis=0)
    y = x.view(np.uint64) - base.view(np.uint64)     # differences of 64-bit integers, exact modulo 2^64
    planes, bits = bit_planes(y)
    kind = np.int64 if rows << (2 * int(bits.max(initial=0))) < _EXACT else object
    weight = np.array([1 << k for b in bits for k in range(b)], dtype=kind)
    live = np.flatnonzero(bits)                      # constant dimensions have no planes
    first = np.concatenate([[0], np.cumsum(bits[live])])[:-1].astype(np.int64)
    sums = np.zeros(dims, dtype=kind)
    products = np.zeros((dims, dims), dtype=kind)
    if len(live):
        alone = np.bitwise_count(planes).sum(axis=1, dtype=np.int64).astype(kind) * weight
        sums[live] = np.add.reduceat(alone, first)
    for a, i in enumerate(live):
        later = planes[first[a]:]
        for k in range(bits[i]):
            both = np.bitwise_count(later & later[k]).sum(axis=1, dtype=np.int64).astype(kind)
            products[i, live[a:]] += np.add.reduceat(both * weight[first[a]:], first[a:] - first[a]) * weight[first[a] + k]
    products = np.triu(products) + np.triu(products, 1).T
    sums, products, b = sums.astype(object), products.astype(object), base.astype(object)
    products = products + np.outer(b, sums) + np.outer(sums, b) + rows * np.outer(b, b)
    return rows, sums + rows * b, products


# ------------------------------------------------------------------ fit
@dataclass(frozen=True)
class Whitening:
    """A fitted transform: counts, exact sums, components (rows) and their eigenvalues."""
    dims: int
    n: int
    sums: tuple[int, ...]
    components: np.ndarray       # (count, dims), unit rows, falling eigenvalue
    values: np.ndarray           # eigenvalues of the components
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S`` as exact integers: 64-bit ones where they fit, Python integers otherwise."""
        top = self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, self.sums), default=0)
        kind = np.int64 if top < _EXACT else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Sum of squares of each row; null where it does not fit a long."""
        top = int(np.abs(centred).max(initial=0))
        c = centred if top * top * max(self.dims, 1) < _EXACT else centred.astype(object)
        return [int(v) if v <= LONG_MAX else None for v in (c * c).sum(axis=1).tolist()]

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened coordinates (rows x components); zero along components without variance."""
        scaled = (centred / self.n).astype(np.float64)
        scale = np.where(self.values > 0, np.sqrt(np.where(self.values > 0, self.values, 1.0)), np.inf)
        return scaled @ self.components.T / scale


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for several partials of the same band."""
    values = sum(np.array([int(v) for v in row], dtype=object) for row in pdf["entries"])
    return pdf.iloc[:1].assign(n=int(pdf["n"].sum()), entries=[[str(v) for v in values]])


def scatter(vectors: DataFrame, vector_col: str = "embedding", *, scale: int = SCALE, offset: int = OFFSET,
            block_rows: int = BLOCK_ROWS) -> tuple[int, int, list[int], list[list[int]]]:
    """Dimensions, row count, sums and cross-products of all usable vectors, exact.

    The dimensions are those of the longest usable vector; shorter ones lack
    entries and do not count.  (0, 0, [], []) without any.
    """
    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = {}, {}

        def fold(d: int) -> None:
            one = cross_products(np.concatenate(held.pop(d)))
            total[d] = tuple(a + b for a, b in zip(total[d], one)) if d in total else one

        for batch in batches:
            for d, (_, matrix) in finite_vectors(batch.column(0))[1].items():
                for at in range(0, len(matrix), block_rows):
                    held.setdefault(d, []).append(as_integers(matrix[at:at + block_rows], scale, offset))
                    if sum(map(len, held[d])) >= block_rows:
                        fold(d)
        for d in list(held):
            fold(d)
        slot = TaskContext.get().partitionId() % SLOTS
        for d, (n, sums, products) in total.items():
            lines = np.vstack([sums[None], products])      # line 0 holds the sums
            wide = max(1, BAND_ENTRIES // d)
            for band in range(-(-len(lines) // wide)):
                entries = lines[band * wide:(band + 1) * wide].ravel()
                yield pa.RecordBatch.from_arrays([
                    pa.array([d], pa.int32()), pa.array([band], pa.int32()), pa.array([slot], pa.int32()),
                    pa.array([n], pa.int64()), pa.array([[str(v) for v in entries]], pa.list_(pa.string()))],
                    names=["dims", "band", "slot", "n", "entries"])

    parts = vectors.select(vector_col).mapInArrow(partials, PARTIAL_SCHEMA)
    merged = parts.groupBy("dims", "band", "slot").applyInPandas(_merge, PARTIAL_SCHEMA) \
        .groupBy("dims", "band").applyInPandas(_merge, PARTIAL_SCHEMA).checkpoint(eager=True)
    d = merged.agg(F.max("dims")).first()[0]
    if d is None:
        return 0, 0, [], []
    rows = merged.where(F.col("dims") == d).orderBy("band").collect()      # d + d^2 integers
    lines = [int(v) for r in rows for v in r["entries"]]
    return d, rows[0]["n"], lines[:d], [lines[i * d:(i + 1) * d] for i in range(1, d + 1)]


def fit(vectors: DataFrame, vector_col: str = "embedding", *, components: int = 8, **options) -> Whitening | None:
    """Components of the covariance (divisor n) of all usable vectors; None without any.

    A component's sign makes its entry of the largest size positive.  Eigenvalues
    below the rounding of the largest one count as zero.
    """
    d, n, sums, products = scatter(vectors, vector_col, **options)
    if not n:
        return None
    square = n * n
    cov = np.array([[(n * products[i][j] - sums[i] * sums[j]) / square for j in range(d)] for i in range(d)])
    values, directions = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    rows = directions.T[order]
    turn = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])
    trace = float(np.trace(cov))
    kept = np.where(values[order] > d * np.finfo(float).eps * max(values.max(), 0.0), values[order], 0.0)
    return Whitening(d, n, tuple(sums), rows * np.where(turn == 0, 1.0, turn)[:, None], kept, trace)


# ------------------------------------------------------------------ transform
def _rows(model: Whitening, column: pa.Array, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors of a batch and their ``n * x - S``."""
    rows, matrix = finite_vectors(column)[1].get(model.dims, (np.zeros(0, dtype=np.int64), np.zeros((0, model.dims))))
    return rows, model.centred(as_integers(matrix, scale, offset))


def identity_error(vectors: DataFrame, model: Whitening, vector_col: str = "embedding", *, scale: int = SCALE,
                   offset: int = OFFSET) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    used = np.flatnonzero(model.values > 0)
    if not len(used):
        return 0.0

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, moment = 0, np.zeros(len(used)), np.zeros((len(used), len(used)))
        for batch in batches:
            _, centred = _rows(model, batch.column(0), scale, offset)
            if len(centred):
                w = model.project(centred)[:, used]
                m, own = len(w), w.mean(axis=0)
                step = own - mean
                moment += (w - own).T @ (w - own) + np.outer(step, step) * (n * m / (n + m))
                mean, n = mean + step * (m / (n + m)), n + m
        if n:   # sums around zero, where the whitened mean lies up to rounding
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()),
                                              "first": pa.array([(mean * n).tolist()], pa.list_(pa.float64())),
                                              "second": pa.array([(moment + n * np.outer(mean, mean)).ravel().tolist()],
                                                                 pa.list_(pa.float64()))})

    k = len(used)
    parts = vectors.select(vector_col).mapInArrow(partials, "n long, first array<double>, second array<double>")
    total = parts.agg(F.sum("n").alias("n"), *[F.sum(F.col("first")[i]).alias(f"f{i}") for i in range(k)],
                      *[F.sum(F.col("second")[i]).alias(f"s{i}") for i in range(k * k)]).first()
    mean = np.array([total[f"f{i}"] for i in range(k)]) / total["n"]
    cov = np.array([total[f"s{i}"] for i in range(k * k)]).reshape(k, k) / total["n"] - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8,
           scale: int = SCALE, offset: int = OFFSET, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Whitened coordinates of all usable vectors, one row per vector and component:
    vec_id, component, n, deviation, whitened, explained, identity_error.

    A vector is usable if it is not null, has no null or non-finite entry and has as
    many entries as the longest usable one; the others give no rows.  Empty vectors
    and empty tables give none either.  Repeated rows and null ids are rows of their
    own; extra columns are ignored.  Vectors without any spread (a single one, say)
    get ``whitened`` and ``explained`` 0 along components without variance, which
    the identity error leaves out.  ``deviation`` is null where it exceeds a long,
    and entries beyond the range of longs count as its ends.
    """
    spark = prepared(vectors).sparkSession
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    kind = own.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    model = fit(own, components=components, scale=scale, offset=offset, block_rows=block_rows)
    if model is None:
        return spark.createDataFrame([], schema)
    error = identity_error(own, model, scale=scale, offset=offset)
    k = len(model.values)
    share = model.values / model.trace if model.trace > 0 else np.zeros(k)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, centred = _rows(model, batch.column(1), scale, offset)
            m = len(at)
            if not m:
                continue
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)), pa.array(model.deviations(centred), pa.int64()).take(pa.array(each)),
                pa.array(model.project(centred).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return own.mapInArrow(rows, schema)
