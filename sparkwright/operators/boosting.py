"""Boosted trees over one binned copy of the features (K3, K4, K5 and boosted regression).

Features are cut into at most 32 bins once.  A round grows one tree per class (softmax),
or a single one (two classes, regression): every task folds its rows into histograms of
the open nodes of all classes at once, the histograms are summed per class, and the
split of each node is picked where they are summed; the driver gets one row per node.
While the table is small (``LOCAL_ROWS``) a round is a single job: a class's rows, already
binned, meet in one task, which grows the whole tree with the same functions.  Both ways
pick the same splits.  Of two sibling nodes only the one with fewer rows is counted, the
other one is their parent less it.

Where few bins cannot tell rows apart, rows of the same bins and class are one row with
a weight (in regression, of the same bins: squared errors need the mean of their labels).
Binned rows travel in blocks of columns, in a number of parts that follows the cores and
the bytes of the blocks, so that histograms sent stay few.

Scores are kept per round, and written every ``KEEP_ROUNDS`` rounds to the shared checkpoint
folder.  AdaBoost needs no scores at all, its weights follow from the stumps so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.operators.storage import StoredModel
from sparkwright.session import checkpoint_dir, cut_lineage, ship_package

BINS = 32
LOCAL_ROWS = 65_536        # rows up to which a class's rows meet in one task
KEEP_ROUNDS = 10           # rounds between written scores
MERGE_SLOTS = 64           # histograms of more partitions are summed in two steps
BLOCK_ROWS = 131_072       # rows of a packed block
PART_BYTES = 128 << 20     # packed bytes of a part, beyond one part a core
SEED = 42


# ------------------------------------------------------------------ bins
def bin_edges(df: DataFrame, dims: int, bins: int = BINS) -> list[list[float]]:
    """Ascending cut values of every feature (quantiles of all rows); a value up to a cut lies left of it."""
    probs = [(k + 1) / bins for k in range(bins - 1)]
    x = df.select(vector_to_array("features").alias("x"))
    row = x.agg(*[F.percentile_approx(F.col("x")[j], probs, 1000).alias(f"q{j}") for j in range(dims)],
                *[F.max(F.col("x")[j]).alias(f"m{j}") for j in range(dims)]).first()
    return [sorted({v for v in row[f"q{j}"] or [] if v < row[f"m{j}"]}) for j in range(dims)]


def to_bins(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin numbers (rows x features) of values; NaN goes to the last bin."""
    out = np.empty(x.shape, dtype=np.uint8)
    for j, cuts in enumerate(edges):
        out[:, j] = np.searchsorted(np.asarray(cuts, dtype=float), x[:, j], side="left")
    return out


def _matrix(column: pa.Array, width: int, kind: type = float) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(len(column), width)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), width)


# ------------------------------------------------------------------ trees
@dataclass(frozen=True)
class Rule:
    """How trees grow: ``level`` (all nodes of a level), ``leaves`` (the best nodes of a level, up to ``leaves``
    leaves) or ``oblivious`` (one split for all nodes of a level)."""
    growth: str = "level"
    depth: int = 6
    leaves: int = 31
    l2: float = 0.0
    min_rows: int = 1
    min_hessian: float = 0.0
    newton: bool = True        # gain by gradients and hessians; otherwise by gradients and row counts
    rate: float = 0.1
    shrink: float = 1.0        # factor of leaf values beside the rate


def empty_tree(depth: int) -> dict[str, np.ndarray]:
    """Nodes in heap order: node i has the children 2 i + 1 and 2 i + 2; feature -1 marks a leaf."""
    n = 2 ** (depth + 1) - 1
    return {"feature": np.full(n, -1, dtype=np.int32), "cut": np.zeros(n, dtype=np.int32), "value": np.zeros(n)}


def walk(bins: np.ndarray, tree: dict[str, np.ndarray], levels: int) -> np.ndarray:
    """The node that every row reaches after at most ``levels`` steps."""
    node = np.zeros(len(bins), dtype=np.int64)
    rows = np.arange(len(bins))
    for _ in range(levels):
        f = tree["feature"][node]
        right = bins[rows, np.maximum(f, 0)] > tree["cut"][node]
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node


def pair_codes(bins: np.ndarray) -> np.ndarray:
    """Numbers of the bins of neighbouring features together (pairs x rows); the last one of an odd number goes alone."""
    cols = bins.T
    left, right = cols[0::2].astype(np.uint16), cols[1::2]
    left[:len(right)] = left[:len(right)] * BINS + right
    return left


def histogram(bins: np.ndarray, slot: np.ndarray, stats: np.ndarray, slots: int, codes: np.ndarray | None = None) -> np.ndarray:
    """Sums of ``stats`` (rows x s) by slot, feature and bin; rows of slot -1 are left out.

    With the ``codes`` of neighbouring features, two are counted at once, by their bins together, and summed over
    each of them; without, every sum runs in the order of the rows.
    """
    own = np.flatnonzero(slot >= 0)
    d, s = bins.shape[1], stats.shape[1]
    out = np.zeros((slots, d, BINS, s))
    slot, weights = slot[own], stats[own].T.copy()
    step = 1 if codes is None else 2
    for a in range(0, d, step):
        paired = step == 2 and a + 1 < d
        code, cells = bins[:, a] if codes is None else codes[a // 2], BINS * BINS if paired else BINS
        at = slot * cells + (code if len(own) == len(code) else code[own])
        for k in range(s):
            both = np.bincount(at, weights=weights[k], minlength=slots * cells).reshape(slots, -1, BINS)
            if paired:
                out[:, a, :, k], out[:, a + 1, :, k] = both.sum(axis=2), both.sum(axis=1)
            else:
                out[:, a, :, k] = both[:, 0]
    return out


def leaf_value(stats: np.ndarray, rule: Rule) -> float:
    g, h = float(stats[0]), float(stats[1])
    return -rule.rate * rule.shrink * g / max(h + rule.l2, 1e-12)


def decide(hist: np.ndarray, rule: Rule, splits_so_far: int, allowed: np.ndarray) -> list[tuple]:
    """Splits of the open nodes of one level: (slot, feature, cut, gain, left sums, right sums), gain above zero.

    ``hist`` has the sums of gradients, hessians and rows per slot, feature and bin.
    """
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    total = hist[:, 0].sum(axis=1)[:, None, None]
    right = total - left

    def score(s: np.ndarray) -> np.ndarray:
        weight = s[..., 1] + rule.l2 if rule.newton else s[..., 2]
        return np.divide(s[..., 0] ** 2, weight, out=np.zeros(s.shape[:-1]), where=weight > 1e-12)

    gain = score(left) + score(right) - score(total)
    fine = (left[..., 2] >= rule.min_rows) & (right[..., 2] >= rule.min_rows) & allowed[None, :, None] \
        & (left[..., 1] >= rule.min_hessian) & (right[..., 1] >= rule.min_hessian)
    gain = np.where(fine, gain, 0.0)
    slots, d, cuts = gain.shape
    if rule.growth == "oblivious":
        at = int(gain.sum(axis=0).argmax())
        best = np.full(slots, at)
    else:
        best = gain.reshape(slots, -1).argmax(axis=1)
    found = []
    for k in range(slots):
        f, c = divmod(int(best[k]), cuts)
        if gain[k, f, c] > 1e-12:
            found.append((k, f, c, float(gain[k, f, c]), left[k, f, c], right[k, f, c]))
    if rule.growth == "leaves":
        found.sort(key=lambda r: (-r[3], r[0]))
        found = found[:max(0, rule.leaves - 1 - splits_so_far)]
    return found


def open_nodes(tree: dict[str, np.ndarray], level: int) -> list[int]:
    """Nodes of a level that exist (the root, or children of split nodes)."""
    first = 2 ** level - 1
    return [n for n in range(first, 2 * first + 1) if n == 0 or tree["feature"][(n - 1) // 2] >= 0]


def add_splits(tree: dict[str, np.ndarray], splits: list[tuple], nodes: list[int], rule: Rule) -> None:
    for k, f, c, _, left, right in splits:
        n = nodes[k]
        tree["feature"][n], tree["cut"][n] = f, c
        tree["value"][2 * n + 1], tree["value"][2 * n + 2] = leaf_value(left, rule), leaf_value(right, rule)


def _slots(bins: np.ndarray, tree: dict[str, np.ndarray], level: int, nodes: list[int]) -> np.ndarray:
    """Slot among ``nodes`` of every row, -1 for rows in other leaves."""
    place = np.full(len(tree["feature"]), -1, dtype=np.int64)
    place[nodes] = np.arange(len(nodes))
    return place[walk(bins, tree, level)]


# ------------------------------------------------------------------ gradients
def class_scores(kind: str, scores: np.ndarray) -> np.ndarray:
    if kind == "softmax":
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
    return 1.0 / (1.0 + np.exp(-scores)) if kind == "logistic" else scores


def gradients(kind: str, p: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss in the score of class ``k``, from its column of ``class_scores``."""
    if kind == "squared":
        return p - label, np.ones(len(label))
    y = (label == k) if kind == "softmax" else (label == 1)
    return p - y, p * (1.0 - p)


class TreeBoosting(Estimator):
    """Gradient boosting: ``softmax`` or ``logistic`` loss by the number of classes, ``squared`` for numbers."""

    def __init__(self, rounds: int = 100, rule: Rule | None = None, subsample: float = 1.0, colsample: float = 1.0,
                 regression: bool = False, seed: int = SEED, local_rows: int | None = None):
        super().__init__()
        self.rounds, self.rule, self.seed = rounds, rule or Rule(), seed
        self.subsample, self.colsample, self.regression = subsample, colsample, regression
        self.local_rows = LOCAL_ROWS if local_rows is None else local_rows

    def _fit(self, df: DataFrame) -> "TreeBoostingModel":
        spark = df.sparkSession
        checkpoint_dir(spark)
        ship_package(spark)
        rows = df.select("features", F.col("label").cast("double").alias("label")).where("features IS NOT NULL AND label IS NOT NULL")
        first = rows.select("features").first()
        if first is None:
            raise ValueError("no rows to fit")
        dims = len(first[0])
        edges = bin_edges(rows, dims)
        if self.regression:
            stats = rows.agg(F.count("label"), F.avg("label")).first()
            kind, n, classes, base = "squared", stats[0], 1, [float(stats[1])]
        else:
            tally = {int(r[0]): r[1] for r in rows.groupBy("label").count().collect()}   # one row per class
            n, classes = sum(tally.values()), max(max(tally) + 1, 2)
            share = [max(tally.get(k, 0), 1e-9) / n for k in range(classes)]
            kind = "logistic" if classes == 2 else "softmax"
            base = [math.log(share[1] / share[0])] if kind == "logistic" else [math.log(s) for s in share]
        heads = len(base)
        rule = self.rule
        if kind == "softmax" and not rule.newton:
            rule = Rule(**{**asdict(rule), "shrink": (classes - 1) / classes})

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = to_bins(_matrix(batch.column(0), dims), edges)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), batch.column(1), batch.column(2),
                                                  pa.array(np.ones(len(bins)))], names=["bins", "label", "u", "weight"])

        x = vector_to_array("features")
        source = rows.select(x.alias("x"), "label", (F.pmod(F.xxhash64(x, F.lit(self.seed)), F.lit(1 << 30)) / (1 << 30)).alias("u")) \
            .mapInArrow(binned, "bins binary, label double, u double, weight double")
        cells = math.prod(len(e) + 1 for e in edges) * (1 if self.regression else classes)
        if self.subsample >= 1.0 and 2 * cells <= n:        # no more rows than these can differ
            keys = ["bins"] if self.regression else ["bins", "label"]
            source = source.groupBy(*keys).agg(F.sum("weight").alias("weight"), F.min("u").alias("u"),
                                               *([F.avg("label").alias("label")] if self.regression else []))
            n = cells
        source = source.select("bins", "label", "u", "weight").mapInArrow(_blocks(dims, base), STATE_SCHEMA)
        grow, parts = _grow_local, max(1, n // 20_000)
        if n > self.local_rows:
            grow, parts = _grow_by_level, max(spark.sparkContext.defaultParallelism, -(-n * (dims + 8 * heads + 24) // PART_BYTES))
        dealt = source.coalesce(parts) if grow is _grow_local else source.repartition(parts)
        state = cut_lineage(dealt.mapInArrow(_joined(dims, heads), STATE_SCHEMA)).persist()
        older = None
        trees: list[list[dict[str, np.ndarray]]] = []
        gains = np.zeros(dims)
        try:
            for step in range(self.rounds):
                if step:
                    older = state
                    state = older.mapInArrow(_added(trees[-1], dims, heads, rule.depth), STATE_SCHEMA)
                    state = (cut_lineage(state) if step % KEEP_ROUNDS == 0 else state).persist()
                own, gained = grow(state, kind, heads, dims, rule, self._allowed(step, dims), self._share(step), parts)
                if older is not None:
                    older.unpersist()
                gains += gained
                trees.append(own)
        finally:
            state.unpersist()
            if older is not None:
                older.unpersist()
        return TreeBoostingModel(kind, base, edges, trees, rule.depth, gains.tolist())

    def _allowed(self, step: int, dims: int) -> np.ndarray:
        """Features of a round."""
        rng = np.random.default_rng([self.seed, step])
        out = np.zeros(dims, dtype=bool)
        out[rng.permutation(dims)[:max(1, round(self.colsample * dims))]] = True
        return out

    def _share(self, step: int) -> tuple[float, float]:
        """A row takes part in a round if its number, shifted by the round, lies below the share."""
        return self.subsample, math.fmod(0.6180339887498949 * (step + 1), 1.0)


STATE_SCHEMA = "bins binary, label binary, scores binary, u binary, weight binary"


@dataclass
class Block:
    """Binned rows by column: bins (rows x features, a feature's bins lie together), labels, scores, shares, weights."""
    bins: np.ndarray
    label: np.ndarray
    scores: np.ndarray
    u: np.ndarray
    weight: np.ndarray

    def batch(self) -> pa.RecordBatch:
        columns = (self.bins.T, self.label, self.scores, self.u, self.weight)
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns],
                                          names=["bins", "label", "scores", "u", "weight"])


def _read(batches: Iterator[pa.RecordBatch], dims: int, heads: int) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            bins, label, scores, u, weight = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint8 if c == 0 else float)
                                              for c in range(5))
            yield Block(bins.reshape(dims, -1).T, label, scores.reshape(-1, heads), u, weight)


def _blocks(dims: int, base: list):
    """Kernel that packs binned rows, with their first scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                label, u, weight = (np.asarray(batch.column(c)) for c in ("label", "u", "weight"))
                yield Block(_bytes(batch.column("bins"), dims), label, np.tile(np.array(base, dtype=float), (len(label), 1)), u, weight).batch()
    return run


def _joined(dims: int, heads: int):
    """Kernel that joins small blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Block] = []

        def joined() -> pa.RecordBatch:
            return Block(np.concatenate([b.bins.T for b in held], axis=1).T,
                         *[np.concatenate([getattr(b, c) for b in held]) for c in ("label", "scores", "u", "weight")]).batch()

        for block in _read(batches, dims, heads):
            if held and sum(len(b.u) for b in held) + len(block.u) > BLOCK_ROWS:
                yield joined()
                held = []
            held.append(block)
        if held:
            yield joined()
    return run


def _added(trees: list, dims: int, heads: int, depth: int):
    """Kernel that adds a round's trees to the scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _read(batches, dims, heads):
            steps = [tree["value"][walk(block.bins, tree, depth)] for tree in trees]
            block.scores = block.scores + np.column_stack(steps)
            yield block.batch()
    return run


def _row_stats(block: Block, p: np.ndarray, kind: str, k: int, share: tuple[float, float]) -> np.ndarray:
    """Gradient, hessian and row count of a block for class ``k`` (zero for rows that sit a round out)."""
    g, h = gradients(kind, p[:, k], block.label, k)
    part = block.weight * (np.mod(block.u + share[1], 1.0) < share[0]) if share[0] < 1.0 else block.weight
    return np.column_stack([g * part, h * part, part])


SPLIT_SCHEMA = ("head int, node int, feature int, cut int, gain double, parent array<double>, left array<double>, "
                "right array<double>")


def _split_rows(head: int, splits: list[tuple], nodes: list[int], total: np.ndarray) -> list[tuple]:
    rows = [(head, nodes[k], f, c, gain, total.tolist(), left.tolist(), right.tolist()) for k, f, c, gain, left, right in splits]
    return rows or [(head, -1, -1, 0, 0.0, total.tolist(), None, None)]


def _planted(rows: list, heads: int, rule: Rule, dims: int) -> tuple[list, np.ndarray]:
    """Trees and gains from split rows of a whole round."""
    trees, gains = [empty_tree(rule.depth) for _ in range(heads)], np.zeros(dims)
    for r in sorted(rows, key=lambda r: r["node"]):
        if r["node"] < 0:
            if trees[r["head"]]["feature"][0] < 0:
                trees[r["head"]]["value"][0] = leaf_value(np.array(r["parent"]), rule)
            continue
        add_splits(trees[r["head"]], [(0, r["feature"], r["cut"], r["gain"], np.array(r["left"]), np.array(r["right"]))],
                   [r["node"]], rule)
        gains[r["feature"]] += r["gain"]
    return trees, gains


def _grow_local(state: DataFrame, kind: str, heads: int, dims: int, rule: Rule, allowed: np.ndarray,
                share: tuple[float, float], parts: int) -> tuple[list, np.ndarray]:
    """One round as one job: binned rows of a bounded table, grouped by class."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _read(batches, dims, heads):
            p, packed = class_scores(kind, block.scores), block.bins.T.tobytes()
            yield pa.RecordBatch.from_pydict({
                "head": pa.array(range(heads), pa.int32()), "bins": pa.array([packed] * heads, pa.binary()),
                "stats": pa.array([_row_stats(block, p, kind, k, share).tobytes() for k in range(heads)], pa.binary())})

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        bins = np.concatenate([np.frombuffer(b, dtype=np.uint8).reshape(dims, -1) for b in pdf["bins"]], axis=1).T
        stats = np.frombuffer(b"".join(pdf["stats"])).reshape(-1, 3)
        tree, rows = empty_tree(rule.depth), []
        for level in range(rule.depth):
            nodes = open_nodes(tree, level)
            if not nodes:
                break
            hist = histogram(bins, _slots(bins, tree, level, nodes), stats, len(nodes))
            splits = decide(hist, rule, len(rows), allowed)
            add_splits(tree, splits, nodes, rule)
            rows += [r for r in _split_rows(int(pdf["head"].iloc[0]), splits, nodes, stats.sum(axis=0)) if r[1] >= 0]
        rows = rows or _split_rows(int(pdf["head"].iloc[0]), [], [], stats.sum(axis=0))
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SPLIT_SCHEMA.split(", ")])

    rows = state.mapInArrow(deal, "head int, bins binary, stats binary").groupBy("head") \
        .applyInPandas(build, SPLIT_SCHEMA).collect()              # one row per split node
    return _planted(rows, heads, rule, dims)


HIST_SCHEMA = "head int, hist binary"


def _counted(found: list, head: int, nodes: list[int]) -> list[int]:
    """Of every two sibling nodes the one with fewer rows; the root alone."""
    if nodes in ([], [0]):
        return nodes
    rows = {r["node"]: (r["left"][2], r["right"][2]) for r in found if r["head"] == head and r["node"] >= 0}
    return [2 * n + (1 if rows[n][0] <= rows[n][1] else 2) for n in sorted({(c - 1) // 2 for c in nodes})]


def _with_siblings(counted: np.ndarray, above: np.ndarray, asked: list[int], nodes: list[int], before: list[int]) -> np.ndarray:
    """Histograms of all ``nodes``: counted ones, and their parents' less them (no rows: no sums either)."""
    place, parent = {n: i for i, n in enumerate(asked)}, {n: i for i, n in enumerate(before)}
    out = np.empty((len(nodes), *counted.shape[1:]))
    for i, n in enumerate(nodes):
        if n in place:
            out[i] = counted[place[n]]
        else:
            rest = above[parent[(n - 1) // 2]] - counted[place[n + 1 if n % 2 else n - 1]]
            out[i] = np.where(rest[..., 2:] > 0.5, rest, 0.0)
    return out


def _grow_by_level(state: DataFrame, kind: str, heads: int, dims: int, rule: Rule, allowed: np.ndarray,
                   share: tuple[float, float], parts: int) -> tuple[list, np.ndarray]:
    """One round of any table: one job per level, histograms of all classes at once."""
    found: list = []
    above, before = None, [[] for _ in range(heads)]
    for level in range(rule.depth):
        trees, _ = _planted(found, heads, rule, dims)
        nodes = [open_nodes(t, level) for t in trees]
        if not any(nodes):
            break
        asked = [_counted(found, k, nodes[k]) for k in range(heads)]
        hists = _node_histograms(state, above, kind, heads, dims, trees, level, nodes, asked, before, share, parts).persist()
        done = [sum(1 for r in found if r["head"] == k and r["node"] >= 0) for k in range(heads)]
        found += hists.mapInArrow(_picked(dims, rule, done, allowed, nodes), SPLIT_SCHEMA).collect()   # one row per split node
        if above is not None:
            above.unpersist()
        above, before = hists, nodes
    if above is not None:
        above.unpersist()
    return _planted(found, heads, rule, dims)


def _picked(dims: int, rule: Rule, done: list[int], allowed: np.ndarray, nodes: list[list[int]]):
    """Kernel that picks the splits of a level from its histograms."""
    names = [c.split(" ")[0] for c in SPLIT_SCHEMA.split(", ")]
    kinds = [pa.int32()] * 4 + [pa.float64()] + [pa.list_(pa.float64())] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                hist = np.frombuffer(packed.as_buffer()).reshape(-1, dims, BINS, 3)
                rows = _split_rows(k, decide(hist, rule, done[k], allowed), nodes[k], hist[0, 0].sum(axis=0))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)
    return run


def _node_histograms(state: DataFrame, above: DataFrame | None, kind: str, heads: int, dims: int, trees: list, level: int,
                     nodes: list, asked: list, before: list, share: tuple[float, float], parts: int) -> DataFrame:
    """Histograms of a level's open nodes, one row per class."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for block in _read(batches, dims, heads):
            p, codes = class_scores(kind, block.scores), pair_codes(block.bins)
            for k in range(heads):
                if asked[k]:
                    one = histogram(block.bins, _slots(block.bins, trees[k], level, asked[k]),
                                    _row_stats(block, p, kind, k, share), len(asked[k]), codes)
                    total[k] = total[k] + one if k in total else one
        slot = TaskContext.get().partitionId() % MERGE_SLOTS
        for k, hist in total.items():
            yield pa.RecordBatch.from_pydict({"head": pa.array([k], pa.int32()), "slot": pa.array([slot], pa.int32()),
                                              "hist": pa.array([hist.tobytes()], pa.binary())})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(hist=[sum(np.frombuffer(b) for b in pdf["hist"]).tobytes()])

    def complete(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        if not len(new):                     # nothing of this class is open any more
            return old.iloc[:0]
        counted, parent = (sum(np.frombuffer(b) for b in t["hist"]).reshape(-1, dims, BINS, 3) for t in (new, old))
        return pd.DataFrame({"head": [k], "hist": [_with_siblings(counted, parent, asked[k], nodes[k], before[k]).tobytes()]})

    hists = state.mapInArrow(fold, "head int, slot int, hist binary")
    if parts > MERGE_SLOTS:
        hists = hists.groupBy("head", "slot").applyInPandas(merge, "head int, slot int, hist binary")
    width = min(heads, state.sparkSession.sparkContext.defaultParallelism)      # a kept plan is not made narrower by itself
    hists = hists.select("head", "hist").repartition(width, "head").groupBy("head")
    return hists.applyInPandas(merge, HIST_SCHEMA) if above is None else \
        hists.cogroup(above.repartition(width, "head").groupBy("head")).applyInPandas(complete, HIST_SCHEMA)


# ------------------------------------------------------------------ fitted models
def features_udf(score, features: Column) -> Column:
    """Array column of scores from a numpy function of the feature matrix; only the features reach Python."""
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(score(np.array(x.tolist(), dtype=float)))) if len(x) else pd.Series([], dtype=object)
    return run(vector_to_array(features))


def with_classes(df: DataFrame, raw: Column, probability: Column | None) -> DataFrame:
    """Prediction (smallest class of the largest score), raw scores and probabilities of classes."""
    cols = [c for c in df.columns if c not in ("prediction", "rawPrediction", "probability")]
    out = df.select(*cols, raw.alias("__raw"))
    top = (F.array_position("__raw", F.array_max("__raw")) - 1).cast("double")
    parts = [top.alias("prediction"), array_to_vector("__raw").alias("rawPrediction")]
    if probability is not None:
        parts.append(array_to_vector(probability).alias("probability"))
    return out.select(*cols, *parts)


def soft(raw: str = "__raw") -> Column:
    """Softmax of an array column."""
    e = F.transform(F.col(raw), lambda s: F.exp(s - F.array_max(F.col(raw))))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))


class TreeBoostingModel(StoredModel):
    def __init__(self, kind: str, base: list, edges: list, trees: list, depth: int, gains: list):
        super().__init__()
        self.kind, self.base, self.edges, self.trees, self.depth, self.gains = kind, base, edges, trees, depth, gains

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - MLlib's name
        total = sum(self.gains)
        return Vectors.dense([g / total if total else 0.0 for g in self.gains])

    def _scores(self, x: np.ndarray) -> np.ndarray:
        bins = to_bins(x, self.edges)
        out = np.tile(np.array(self.base, dtype=float), (len(x), 1))
        for trees in self.trees:
            for k, tree in enumerate(trees):
                out[:, k] += tree["value"][walk(bins, tree, self.depth)]
        return np.column_stack([-out[:, 0] / 2, out[:, 0] / 2]) if self.kind == "logistic" else out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        raw = features_udf(self._scores, F.col("features"))
        if self.kind == "squared":
            cols = [c for c in dataset.columns if c != "prediction"]
            return dataset.select(*cols, raw[0].alias("prediction"))
        return with_classes(dataset, raw, soft())

    def _state(self) -> dict:
        return {"kind": self.kind, "base": self.base, "edges": self.edges, "depth": self.depth, "gains": self.gains,
                "trees": [[{k: v.tolist() for k, v in t.items()} for t in trees] for trees in self.trees]}

    @classmethod
    def _rebuilt(cls, state: dict, tables: dict) -> "TreeBoostingModel":
        kinds = {"feature": np.int32, "cut": np.int32, "value": float}
        trees = [[{k: np.array(v, dtype=kinds[k]) for k, v in t.items()} for t in trees] for trees in state["trees"]]
        return cls(state["kind"], state["base"], state["edges"], trees, state["depth"], state["gains"])


# ------------------------------------------------------------------ AdaBoost
class AdaBoostSAMME(Estimator):
    """SAMME boosting of depth-1 trees.

    A row's weight follows from the stumps so far, so tasks compute it from the binned
    rows and a round is one job: class weights per feature and bin.  The best stump (by
    Gini), its classes and its error all come from those sums.
    """

    def __init__(self, n_estimators: int = 50, learning_rate: float = 1.0):
        super().__init__()
        self.n_estimators, self.learning_rate = n_estimators, learning_rate

    def _fit(self, df: DataFrame) -> "AdaBoostModel":
        spark = df.sparkSession
        checkpoint_dir(spark)
        ship_package(spark)
        rows = df.select("features", F.col("label").cast("double").alias("label")).where("features IS NOT NULL AND label IS NOT NULL")
        dims = len(rows.select("features").first()[0])
        edges = bin_edges(rows, dims)
        top, n = rows.agg(F.max("label"), F.count("label")).first()
        k = max(int(top) + 1, 2)

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = to_bins(_matrix(batch.column(0), dims), edges)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), batch.column(1)],
                                                 names=["bins", "label"])
        state = cut_lineage(rows.select(vector_to_array("features").alias("x"), "label")
                            .mapInArrow(start, "bins binary, label double")).persist()
        stumps: list[dict] = []
        shift = 0.0          # logarithm of the weights' total, so that weights stay in range
        try:
            for _ in range(self.n_estimators):
                stump, error, total = self._round(state, stumps, dims, k, shift)
                if error >= 1 - 1.0 / k and stumps:
                    break
                perfect = error <= 0
                weight = 1.0 if perfect or error >= 1 - 1.0 / k else \
                    self.learning_rate * (math.log((1 - error) / error) + math.log(k - 1))
                stumps.append({**stump, "weight": weight})
                if perfect or error >= 1 - 1.0 / k:
                    break
                shift += math.log(total)
        finally:
            state.unpersist()
        return AdaBoostModel(edges, stumps, k)

    @staticmethod
    def _round(state: DataFrame, stumps: list[dict], dims: int, k: int, shift: float) -> tuple[dict, float, float]:
        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((dims, BINS, k))
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, label = _bytes(batch.column("bins"), dims), np.asarray(batch.column("label")).astype(int)
                log_weight = np.full(len(label), -shift)
                for s in stumps:
                    log_weight += s["weight"] * (np.where(bins[:, s["feature"]] > s["cut"], s["right"], s["left"]) != label)
                stats = np.zeros((len(label), k))
                stats[np.arange(len(label)), label] = np.exp(log_weight)
                total += histogram(bins, np.zeros(len(label), dtype=np.int64), stats, 1)[0]
            yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId() % MERGE_SLOTS], pa.int32()),
                                              "hist": pa.array([total.tobytes()], pa.binary())})

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf.iloc[:1].assign(hist=[sum(np.frombuffer(b) for b in pdf["hist"]).tobytes()])

        parts = state.mapInArrow(fold, "slot int, hist binary").groupBy("slot").applyInPandas(merge, "slot int, hist binary")
        hist = sum(np.frombuffer(r["hist"]) for r in parts.collect()).reshape(dims, BINS, k)   # at most MERGE_SLOTS rows
        left = np.cumsum(hist, axis=1)
        everything = left[:, -1:, :]
        right = everything - left
        sizes = left.sum(axis=2), right.sum(axis=2)
        purity = sum(np.divide((side ** 2).sum(axis=2), w, out=np.zeros(w.shape), where=w > 0)
                     for side, w in zip((left, right), sizes))
        f, c = divmod(int(purity.argmax()), BINS)
        total = float(sizes[0][f, -1])
        lo = int(left[f, c].argmax())
        hi = int(right[f, c].argmax()) if sizes[1][f, c] > 0 else lo
        error = 1.0 - float(left[f, c, lo] + right[f, c, hi]) / total
        return {"feature": f, "cut": c, "left": lo, "right": hi}, max(error, 0.0) if error > 1e-12 else 0.0, total


class AdaBoostModel(StoredModel):
    def __init__(self, edges: list, stumps: list[dict], k: int):
        super().__init__()
        self.edges, self.stumps, self.k = edges, stumps, k

    def _scores(self, x: np.ndarray) -> np.ndarray:
        bins = to_bins(x, self.edges)
        out = np.zeros((len(x), self.k))
        rows = np.arange(len(x))
        for s in self.stumps:
            out[rows, np.where(bins[:, s["feature"]] > s["cut"], s["right"], s["left"])] += s["weight"]
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        top = F.array_max("__raw")
        e = F.transform("__raw", lambda s: F.exp((s - top) / F.lit(float(max(self.k - 1, 1)))))
        share = F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))
        return with_classes(dataset, features_udf(self._scores, F.col("features")), share)

    def _state(self) -> dict:
        return {"edges": self.edges, "stumps": self.stumps, "k": self.k}

    @classmethod
    def _rebuilt(cls, state: dict, tables: dict) -> "AdaBoostModel":
        return cls(state["edges"], state["stumps"], state["k"])
