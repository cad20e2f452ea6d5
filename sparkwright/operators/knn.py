"""Exact k-nearest-neighbour search by pivot cells.

Points are dealt to the nearest of a bounded number of pivots and sorted by their
distance to it; consecutive points are packed into cells of a bounded size, so a
large cell is split into rings around its pivot.  A cell knows its pivot, the
smallest and largest distance to it, and its bounding box.  No point of a cell is
nearer to a query than the triangle inequality (distance to the ring) and the box
allow; for the NaN-aware distance, which is no metric, the box alone counts, over
the coordinates that both sides have.

The search has two rounds at any size.  The first visits each query's most
promising cells, which gives a k-th distance; the second visits exactly the other
cells whose bound does not exceed it.  Queries travel in packed blocks, one per
group of neighbouring cells that any of them visits, and cells are joined to them by
group.  There are at most ``GROUPS`` groups, so a query is sent, and its best points
of a group are returned, a bounded number of times, however many cells there are:
traffic grows with the points, not with pairs.  Inside a block numpy finds candidates by a matrix product
and takes the distances of those few again by differences, so ties are exact.

Identical points are grouped first (count + one tie key), so a value that
holds a third of all rows is one candidate, not a third of the table.  Ties
in distance are broken by ``md5`` of the point's text, which SQL engines
reproduce.  On points without structure (independent coordinates in high dimension)
no bound excludes a cell: every cell is then visited, which exactness demands.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions.columns import numeric_columns, q
from sparkwright.operators.storage import StoredModel
from sparkwright.session import checkpoint_dir, cut_lineage, scratch_path, ship_package

CELL_ROWS = 512            # points of a cell, until there are too many cells
SUMMARY_BYTES = 16 << 20   # most bytes of all cells' boxes, which every task gets
MOST_PIVOTS = 1024
QUERY_ROWS = 512           # queries of a packed block
SEED_CELLS = 2             # cells of the first round
GROUPS = 64                # most groups of cells, each asked by one copy of a block of queries
MIN_SAME = 32              # a change of the null pattern ends a cell of at least so many points


def point_text(arr: Column) -> Column:
    """Text of a point (nulls as empty), the input of the tie key."""
    return F.array_join(F.transform(arr, lambda e: e.cast("string")), "|", "")


# ------------------------------------------------------------------ distances
def exact_d2(a: np.ndarray, b: np.ndarray, p: int | None) -> np.ndarray:
    """Squared distances of rows to rows, pair by pair (plain, or NaN-aware scaled by p/present)."""
    diff = (a - b) ** 2
    if p is None:
        return diff.sum(axis=-1)
    there = ~np.isnan(diff)
    n = there.sum(axis=-1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, float(p) / np.maximum(n, 1) * np.where(there, diff, 0.0).sum(axis=-1), np.nan)


def about_d2(a: np.ndarray, b: np.ndarray, p: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The same for all pairs by matrix products, and how far rounding may put them off; unusable pairs are infinite."""
    ta, tb = ~np.isnan(a), ~np.isnan(b)
    a0, b0 = np.where(ta, a, 0.0), np.where(tb, b, 0.0)
    one, two = (a0 * a0) @ tb.T.astype(float), ta.astype(float) @ (b0 * b0).T
    d2, off = np.maximum(one + two - 2.0 * (a0 @ b0.T), 0.0), (one + two) * 1e-12
    if p is not None:
        n = ta.astype(float) @ tb.T.astype(float)
        with np.errstate(invalid="ignore", divide="ignore"):
            scale = np.where(n > 0, p / n, np.inf)
        return np.where(n > 0, d2 * np.where(n > 0, scale, 0.0), np.inf), off * np.where(n > 0, scale, 0.0)
    return d2, off


def nearest(Q: np.ndarray, need: np.ndarray, P: np.ndarray, n: np.ndarray, tie: list, k: int, p: int | None,
            limit: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """(query, point, squared distance) of each query's k nearest points by (distance, tie), counting ``n``.

    A query with ``need`` >= 0 uses points that have this coordinate only; ``limit`` leaves out larger distances.
    """
    about, off = about_d2(Q, P, p)
    usable = np.isfinite(about)
    for c in np.unique(need[need >= 0]):
        usable[np.ix_(need == c, np.isnan(P[:, c]))] = False
    about = np.where(usable, about, np.inf)
    at = min(k, P.shape[0]) - 1
    bar = np.partition(about, at, axis=1)[:, at]
    if limit is not None:
        bar = np.minimum(bar, limit)
    out = []
    for i in range(len(Q)):
        own = np.flatnonzero(usable[i] & (about[i] - off[i] <= bar[i] + off[i].max()))
        if len(own):
            d2 = exact_d2(Q[i], P[own], p)
            order = sorted(range(len(own)), key=lambda j: (d2[j], tie[own[j]]))
            got = 0
            for j in order:
                if got >= k or (limit is not None and d2[j] > limit[i]):
                    break
                out.append((i, int(own[j]), float(d2[j])))
                got += int(n[own[j]])
    return out


# ------------------------------------------------------------------ cells
CELL_SCHEMA = ("part int, seq int, pivot int, inner double, outer double, n long, same boolean, lo array<double>, "
               "hi array<double>, points binary, counts array<long>, ties array<string>, carried array<double>")


@dataclass(frozen=True)
class Bounds:
    """What every task knows of the cells: numbers, rings and boxes (at most ``SUMMARY_BYTES``)."""
    p: int | None
    pivots: np.ndarray
    ids: list[tuple[int, int]]
    owner: np.ndarray          # pivot of each cell
    ring: np.ndarray           # inner and outer distance to the pivot
    lo: np.ndarray
    hi: np.ndarray
    same: np.ndarray           # whether all points have the same coordinates

    def least_d2(self, Q: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Smallest squared distance that any point of each cell can have to each query (infinite: no usable point).

        Every entry is computed for itself, so it does not depend on the block that a query stands in.
        """
        out = np.empty((len(Q), len(self.ids)))
        step = max(1, 4_000_000 // max(1, Q.size))
        has = ~np.isnan(self.lo)
        for a in range(0, len(self.ids), step):
            lo, hi, there = self.lo[a:a + step], self.hi[a:a + step], has[a:a + step]
            both = ~np.isnan(Q)[:, None, :] & there
            gap = np.where(both, np.maximum(np.maximum(lo - Q[:, None, :], Q[:, None, :] - hi), 0.0), 0.0) ** 2
            if self.p is None:
                out[:, a:a + step] = gap.sum(axis=2)
                continue
            n = both.sum(axis=2)
            some = np.where(both, gap, np.inf).min(axis=2)       # a mean is no smaller than its least term
            alike = self.p / np.maximum(n, 1) * gap.sum(axis=2)
            out[:, a:a + step] = np.where(n == 0, np.inf, np.where(self.same[a:a + step], alike, self.p * some))
        for c in np.unique(need[need >= 0]):
            out[np.ix_(need == c, ~has[:, c])] = np.inf
        if self.p is None and len(self.ids):
            to = np.hstack([np.sqrt(exact_d2(Q[:, None, :], self.pivots[a:a + step], None))
                            for a in range(0, len(self.pivots), step)])[:, self.owner]
            out = np.maximum(out, np.maximum(np.maximum(self.ring[:, 0] - to, to - self.ring[:, 1]), 0.0) ** 2)
        return out


@dataclass(frozen=True)
class Cells:
    """Packed cells and their bounds."""
    table: DataFrame
    bounds: Bounds

    @classmethod
    def of(cls, table: DataFrame, pivots: np.ndarray, p: int | None) -> "Cells":
        rows = table.select("part", "seq", "pivot", "inner", "outer", "same", "lo", "hi").orderBy("part", "seq").collect()
        corner = [np.array([[np.nan if v is None else v for v in r[c]] for r in rows], dtype=float)
                  .reshape(len(rows), pivots.shape[1]) for c in ("lo", "hi")]
        return cls(table, Bounds(p, pivots, [(r["part"], r["seq"]) for r in rows], np.array([r["pivot"] for r in rows], dtype=int),
                                 np.array([[r["inner"], r["outer"]] for r in rows], dtype=float).reshape(len(rows), 2), *corner,
                                 np.array([r["same"] for r in rows], dtype=bool)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of an array column, nulls as NaN."""
    return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(column), d)


def build_cells(points: DataFrame, d: int, p: int | None, cell_rows: int = CELL_ROWS) -> Cells:
    """Cells of ``x array<double>, n long, t string, carried double`` rows (``x`` distinct up to ``t``)."""
    spark = points.sparkSession
    checkpoint_dir(spark)
    ship_package(spark)
    n = points.count()
    if not n:
        return Cells.of(spark.createDataFrame([], CELL_SCHEMA), np.zeros((0, d)), p)
    size = max(cell_rows, -(-n * 16 * d // SUMMARY_BYTES))
    some = min(MOST_PIVOTS, max(1, n // size))
    picked = points.select("x", F.xxhash64("t").alias("h"), "t").orderBy("h", "t").limit(some).collect()   # bounded
    pivots = np.array([[np.nan if v is None else v for v in r["x"]] for r in picked], dtype=float)
    fill = np.zeros(d)
    if p is not None:           # any point may go to any cell, so means stand in for missing coordinates there
        row = points.agg(*[F.avg(F.col("x")[j]) for j in range(d)]).first()
        fill = np.array([0.0 if v is None else v for v in row])
        pivots = np.where(np.isnan(pivots), fill, pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), d)
            mask = ["".join("01"[v] for v in r) for r in (~np.isnan(x)).astype(int)] if p is not None else [""] * len(x)
            full = np.where(np.isnan(x), fill, x)
            d2 = about_d2(full, pivots, None)[0]
            own = d2.argmin(axis=1)
            r = np.sqrt(exact_d2(full, pivots[own], None))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(mask, pa.string()),
                                              pa.array(r)], names=["x", "n", "t", "carried", "pivot", "mask", "r"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def cell() -> pa.RecordBatch:
            x = np.array([[np.nan if v is None else v for v in h[0]] for h in held], dtype=float)
            ring = [h[6] for h in held]
            low, high = np.where(np.isnan(x), np.inf, x).min(axis=0), np.where(np.isnan(x), -np.inf, x).max(axis=0)
            corner = [[None if np.isinf(v) else float(v) for v in c] for c in (low, high)]
            return pa.RecordBatch.from_pylist([{
                "part": part, "seq": seq, "pivot": held[0][4], "inner": min(ring) * (1 - 1e-12), "outer": max(ring) * (1 + 1e-12),
                "n": len(held), "same": len({h[5] for h in held}) == 1, "lo": corner[0], "hi": corner[1],
                "points": x.tobytes(), "counts": [h[1] for h in held], "ties": [h[2] for h in held],
                "carried": [h[3] for h in held]}], schema=pa.schema([
                    ("part", pa.int32()), ("seq", pa.int32()), ("pivot", pa.int32()), ("inner", pa.float64()),
                    ("outer", pa.float64()), ("n", pa.int64()), ("same", pa.bool_()), ("lo", pa.list_(pa.float64())),
                    ("hi", pa.list_(pa.float64())), ("points", pa.binary()), ("counts", pa.list_(pa.int64())),
                    ("ties", pa.list_(pa.string())), ("carried", pa.list_(pa.float64()))]))

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (len(held) >= size or row[4] != held[0][4] or (row[5] != held[-1][5] and len(held) >= MIN_SAME)):
                    yield cell()
                    seq, held = seq + 1, []
                held.append(row)
        if held:
            yield cell()

    schema = "x array<double>, n long, t string, carried double, pivot int, mask string, r double"
    path = scratch_path(spark, "knn-cells")
    # a cluster may deal to more partitions than asked; neighbouring ones then give whole cells together
    parts = max(1, min(-(-n // (8 * size)), 10_000))
    points.select("x", "n", "t", "carried").mapInArrow(place, schema) \
        .repartitionByRange(parts, "pivot", "mask", "r").sortWithinPartitions("pivot", "mask", "r") \
        .coalesce(parts).mapInArrow(pack, CELL_SCHEMA).write.parquet(path)
    return Cells.of(spark.read.schema(CELL_SCHEMA).parquet(path), pivots, p)


# ------------------------------------------------------------------ search
FOUND_SCHEMA = "qk string, t string, n long, d2 double, carried double"
ASK_SCHEMA = ("team int, ask string, qks array<string>, asked binary, need array<int>, limits array<double>, "
              "at array<long>, visits array<binary>")


def _team_parts(cells: Cells) -> int:
    """Partitions of cells that make one group."""
    return -(-(max(part for part, _ in cells.bounds.ids) + 1) // GROUPS)


def _ask(queries: DataFrame, cells: Cells, d: int, first: bool) -> DataFrame:
    """Packed blocks of queries, one row per group of cells that any of a block visits in this round.

    ``at`` names the group's visited cells (``part * 2^32 + seq``), ``visits`` the queries of each as bits.
    """
    bounds, per = cells.bounds, _team_parts(cells)
    team = np.array([part // per for part, _ in bounds.ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, asks = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_ROWS):
                one = batch.slice(at, QUERY_ROWS)
                Q, need = _matrix(one.column(1), d), np.asarray(one.column(2))
                limit = np.array([np.inf if v is None else v for v in one.column(3).to_pylist()])
                bound = bounds.least_d2(Q, need)
                order = np.argsort(bound, axis=1, kind="stable")[:, :SEED_CELLS]
                seed = np.zeros(bound.shape, dtype=bool)
                np.put_along_axis(seed, order, True, axis=1)
                fits = np.isfinite(bound) & (bound <= (limit * (1 + 1e-9))[:, None])
                visit = seed & fits if first else fits & ~seed
                for g in np.unique(team[visit.any(axis=0)]):
                    own = np.flatnonzero(visit.any(axis=0) & (team == g))
                    rows = np.flatnonzero(visit[:, own].any(axis=1))
                    bits = [np.packbits(visit[rows, c]).tobytes() for c in own]
                    asks += 1
                    yield pa.RecordBatch.from_arrays([
                        pa.array([g], pa.int32()), pa.array([f"{task}-{asks}"], pa.string()),
                        pa.array([one.column(0).take(pa.array(rows)).to_pylist()], pa.list_(pa.string())),
                        pa.array([Q[rows].tobytes()], pa.binary()), pa.array([need[rows].tolist()], pa.list_(pa.int32())),
                        pa.array([limit[rows].tolist()], pa.list_(pa.float64())),
                        pa.array([[(bounds.ids[c][0] << 32) + bounds.ids[c][1] for c in own]], pa.list_(pa.int64())),
                        pa.array([bits], pa.list_(pa.binary()))],
                        names=["team", "ask", "qks", "asked", "need", "limits", "at", "visits"])
    return queries.select("qk", "x", "need", "d2").mapInArrow(run, ASK_SCHEMA)


def _answer(asked: DataFrame, cells: Cells, d: int, k: int) -> DataFrame:
    """The k best points for each query of a block, over the cells of a group that follow one another.

    A join gives a block's cells in a row as a rule; where it does not, more points are returned, none fewer.
    """
    p, per = cells.bounds.p, _team_parts(cells) if cells.bounds.ids else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, block, best = None, None, {}        # best: query -> its (distance, tie, count, carried) so far

        def told() -> Iterator[pa.RecordBatch]:
            rows = [(block["qks"][a], t, n, v, c) for a, got in best.items() for v, t, n, c in got]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(
                    zip(*rows), [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64()])],
                    names=["qk", "t", "n", "d2", "carried"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("ask", "bits", "points", "counts", "ties", "carried")}
                if row["ask"] != ask:
                    yield from told()
                    ask, best = row["ask"], {}
                    block = {c: batch.column(c)[i].as_py() for c in ("qks", "asked", "need", "limits")}
                    Q, need = np.frombuffer(block["asked"]).reshape(-1, d), np.array(block["need"], dtype=int)
                    limits = np.array(block["limits"])
                P = np.frombuffer(row["points"]).reshape(-1, d)
                some = np.flatnonzero(np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), count=len(Q)))
                found: dict[int, list] = {}
                for a, b, v in nearest(Q[some], need[some], P, np.array(row["counts"]), row["ties"], k, p, limits[some]):
                    a = int(some[a])
                    found.setdefault(a, []).append(
                        (v, row["ties"][b], row["counts"][b], row["carried"][b] if need[a] < 0 else float(P[b, need[a]])))
                for a, new in found.items():
                    got, kept = 0, []
                    for point in sorted(best.get(a, []) + new, key=lambda f: f[:2]):
                        if got >= k:
                            break
                        kept.append(point)
                        got += point[2]
                    best[a] = kept
                    if got >= k:      # no later point beyond the farthest of them counts
                        limits[a] = min(limits[a], kept[-1][0])
        yield from told()
    own = cells.table.select("part", "seq", "points", "counts", "ties", "carried") \
        .withColumn("team", F.expr(f"CAST(part DIV {per} AS INT)"))
    place = F.array_position("at", F.col("part").cast("long") * (1 << 32) + F.col("seq"))
    return asked.join(own, "team").where(place > 0).withColumn("bits", F.element_at("visits", place.cast("int"))) \
        .select("ask", "qks", "asked", "need", "limits", "bits", "points", "counts", "ties", "carried") \
        .mapInArrow(run, FOUND_SCHEMA)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Per query the k best points by (distance, tie), counting how often a point occurs (``take`` of them)."""
    w = Window.partitionBy("qk").orderBy("d2", "t").rowsBetween(Window.unboundedPreceding, 0)
    kept = found.withColumn("upto", F.sum("n").over(w)).where(F.col("upto") - F.col("n") < k)
    return kept.withColumn("take", F.least(F.col("n"), F.lit(k) - (F.col("upto") - F.col("n")))).drop("upto")


def search(queries: DataFrame, cells: Cells, d: int, k: int) -> DataFrame:
    """The k nearest points of every query: ``qk, t, n, d2, carried, take``.

    queries: ``qk string, x array<double>, need int`` (distinct ``qk``); with ``need`` >= 0 only points that
    have this coordinate count, and ``carried`` is the coordinate instead of the point's carried value.
    """
    spark = queries.sparkSession
    ship_package(spark)
    if not cells.bounds.ids:
        return spark.createDataFrame([], FOUND_SCHEMA + ", take long")
    open_ = queries.select("qk", "x", "need", F.lit(None).cast("double").alias("d2"))
    seeds = cut_lineage(_best(_answer(_ask(open_, cells, d, True), cells, d, k), k))
    # a query with k points so far needs no point beyond the farthest of them
    limits = seeds.groupBy("qk").agg(F.when(F.sum("take") >= k, F.max("d2")).alias("d2"))
    again = queries.select("qk", "x", "need").join(limits, "qk", "left")
    rest = _answer(_ask(again, cells, d, False), cells, d, k)
    return cut_lineage(_best(seeds.drop("take").unionByName(rest), k))


# ===================================================================== K13
class KNeighbors(Estimator):
    """k-nearest-neighbour classifier (Euclidean, uniform vote; a tied vote
    goes to the smallest class)."""

    def __init__(self, k: int = 5, cell_rows: int = CELL_ROWS):
        super().__init__()
        self.k, self.cell_rows = k, cell_rows

    def _fit(self, df: DataFrame) -> "KNeighborsModel":
        x = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("carried"))
        pts = x.groupBy("x", "carried").agg(F.count(F.lit(1)).alias("n"))
        pts = cut_lineage(pts.withColumn("t", F.md5(F.concat_ws("|", point_text(F.col("x")), F.col("carried").cast("string")))))
        d = len(df.select("features").first()[0])
        n_classes = int(pts.agg(F.max("carried")).first()[0]) + 1
        return KNeighborsModel(build_cells(pts, d, None, self.cell_rows), self.k, n_classes)


class KNeighborsModel(StoredModel):
    def __init__(self, cells: Cells, k: int, n_classes: int):
        super().__init__()
        self.cells, self.k, self.n_classes = cells, k, n_classes

    def _state(self) -> dict:
        return {"pivots": self.cells.bounds.pivots.tolist(), "k": self.k, "n_classes": self.n_classes}

    def _tables(self) -> dict[str, DataFrame]:
        return {"cells": self.cells.table}

    @classmethod
    def _rebuilt(cls, state: dict, tables: dict) -> "KNeighborsModel":
        return cls(Cells.of(tables["cells"], np.array(state["pivots"], dtype=float), None), state["k"], state["n_classes"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        base = dataset.withColumn("__qx", vector_to_array("features")) \
            .withColumn("__qk", F.md5(point_text(F.col("__qx"))))
        queries = base.select(F.col("__qk").alias("qk"), F.col("__qx").alias("x"), F.lit(-1).alias("need")).dropDuplicates(["qk"])
        nn = search(queries, self.cells, self.cells.bounds.pivots.shape[1], self.k)
        votes = nn.groupBy(F.col("qk").alias("__qk"), F.col("carried").alias("label")).agg(F.sum("take").alias("__v"))
        best = votes.groupBy("__qk").agg(
            F.max(F.struct(F.col("__v"), (-F.col("label")).alias("__nl"))).alias("__b"),
            F.sum("__v").alias("__tot"),
            F.map_from_entries(F.collect_list(F.struct(F.col("label").cast("int"), F.col("__v")))).alias("__m"))
        k = self.n_classes
        prob = F.array(*[F.coalesce(F.col("__m")[c], F.lit(0)) / F.col("__tot") for c in range(k)])
        pred = best.select("__qk", (-F.col("__b.__nl")).alias("prediction"),
                           array_to_vector(prob.cast("array<double>")).alias("probability"))
        cols = [c for c in dataset.columns if c not in ("prediction", "probability")]
        return base.join(pred, "__qk", "left").select(*cols, "prediction", "probability")


# ===================================================================== E4
@dataclass
class DonorIndex:
    """Cells of all rows that can give values, for every column at once, and the columns' means."""
    columns: list[str]
    cells: Cells
    means: dict[str, float | None]


def donor_index(df: DataFrame, columns: Sequence[str], cell_rows: int = CELL_ROWS) -> DonorIndex:
    """Index of the rows of ``df`` by their numeric ``columns`` (rows without any value give none)."""
    feats = list(columns)
    means = df.agg(*[F.avg(q(c).cast("double")).alias(c) for c in feats]).first().asDict()
    rows = df.select(F.array(*[q(c).cast("double") for c in feats]).alias("x")).where(F.exists("x", lambda v: v.isNotNull()))
    pts = cut_lineage(rows.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
                      .select("x", "n", F.md5(point_text(F.col("x"))).alias("t"), F.lit(None).cast("double").alias("carried")))
    return DonorIndex(feats, build_cells(pts, len(feats), len(feats), cell_rows), means)


def impute_knn(df: DataFrame, id_col: str | None = None, columns: Sequence[str] | None = None,
               k: int = 5, cell_rows: int = CELL_ROWS, donors: DataFrame | DonorIndex | None = None) -> DataFrame:
    """KNN imputation of numeric columns: each missing cell takes the mean of
    that column over the k nearest rows having it (NaN-aware Euclidean
    distance over all the columns, scaled by total/present coordinates);
    with no usable neighbour, the column mean.  ``id_col`` is accepted for
    interface compatibility; identical rows are imputed identically.
    Neighbours and means come from ``donors`` (rows or their index; ``df`` itself
    when not given).  All columns are searched at once, over one index."""
    feats = list(columns) if columns is not None else [c for c in numeric_columns(df) if c != id_col]
    nulls = df.agg(*[F.count_if(q(c).isNull()).alias(c) for c in feats]).first().asDict() if feats else {}
    if not any(nulls.values()):
        return df
    index = donors if isinstance(donors, DonorIndex) else donor_index(df if donors is None else donors, feats, cell_rows)
    arr = F.array(*[q(c).cast("double") for c in feats])
    base = df.withColumn("__row", arr)
    base = base.withColumn("__rk", F.md5(point_text(F.col("__row"))))
    missing = F.filter(F.sequence(F.lit(0), F.lit(len(feats) - 1)), lambda j: F.element_at(F.col("x"), j + 1).isNull())
    queries = base.where(F.exists("__row", lambda v: v.isNull())).select(F.col("__rk"), F.col("__row").alias("x")) \
        .dropDuplicates(["__rk"]).withColumn("need", F.explode(missing)) \
        .select(F.concat_ws("#", "__rk", "need").alias("qk"), "x", "need")
    nn = search(queries, index.cells, len(feats), k)
    value = nn.groupBy("qk").agg((F.sum(F.col("carried") * F.col("take")) / F.sum("take")).alias("v"))
    key = F.split("qk", "#")
    filled = value.groupBy(key[0].alias("__rk")).agg(F.map_from_entries(F.collect_list(
        F.struct(key[1].cast("int").alias("j"), "v"))).alias("__got"))      # at most one entry per column
    out = base.join(filled, "__rk", "left")
    for j, c in enumerate(feats):
        if nulls[c]:
            out = out.withColumn(c, F.coalesce(q(c).cast("double"), F.col("__got")[j], F.lit(index.means[c])))
    return out.select(*[q(x) for x in df.columns])
