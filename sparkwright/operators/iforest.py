"""Isolation Forest (K18): trees of at most ``max_samples`` rows each.

Sampling: a row's uniform hash picks at most one tree (disjoint windows of
width p = 4*psi/n), then each tree keeps the ``psi`` smallest second hashes
of its ~4*psi candidates - no row explosion and no sort of the table.  With
few rows (n < trees * 4 * psi) every row is offered to every tree instead.
Trees are grown in parallel with ``groupBy(tree).applyInPandas`` (each group
<= 4*psi rows), collected (trees * 2*psi nodes: bounded) and scored with a
vectorised numpy walk inside ``mapInPandas``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.operators.boosting import features_udf
from sparkwright.operators.storage import StoredModel
from sparkwright.session import ship_package

EULER = 0.5772156649015329
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size bigint, leaf boolean, depth int")


def c_factor(n):
    """Average path length of an unsuccessful search in a BST of n nodes."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(tree_id: int, X: np.ndarray, max_depth: int) -> list[tuple]:
    rng = np.random.default_rng(1_000_003 * (tree_id + 1))
    nodes = []

    def build(idx, depth):
        me = len(nodes)
        nodes.append(None)
        sub = X[idx]
        if depth >= max_depth or len(idx) <= 1:
            nodes[me] = (tree_id, me, -1, 0.0, -1, -1, len(idx), True, depth)
            return me
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            nodes[me] = (tree_id, me, -1, 0.0, -1, -1, len(idx), True, depth)
            return me
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < t]
        right = idx[sub[:, f] >= t]
        li = build(left, depth + 1)
        ri = build(right, depth + 1)
        nodes[me] = (tree_id, me, f, t, li, ri, len(idx), False, depth)
        return me
    build(np.arange(len(X)), 0)
    return nodes


class IsolationForestSpark(Estimator):
    def __init__(self, n_trees: int = 100, max_samples: int = 256, seed: int = 42):
        super().__init__()
        self.n_trees, self.max_samples, self.seed = n_trees, max_samples, seed

    def _fit(self, df: DataFrame) -> "IsolationForestModel":
        ship_package(df.sparkSession)
        # one scheme at any size: a tree's candidates are a hashed share of the rows of about four times
        # its sample (all rows of a small table); hashing row numbers keeps repeated points apart
        x = df.select(vector_to_array("features").alias("x")) \
            .withColumn("row", F.monotonically_increasing_id()).checkpoint(eager=True)
        n = x.count()
        psi = min(self.max_samples, n)
        T = self.n_trees
        share = min(1.0, 4.0 * psi / max(n, 1))
        x = x.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(T - 1)), lambda t: F.pmod(
            F.xxhash64(F.lit(self.seed), t, F.col("row")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))))
        w = Window.partitionBy("tree").orderBy(F.xxhash64(F.lit(self.seed + 1), F.col("tree"), F.col("row")), "row")
        sample = x.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= psi).drop("__rn", "row")
        max_depth = int(math.ceil(math.log2(max(psi, 2))))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            X = np.array(pdf["x"].tolist(), dtype=float)
            return pd.DataFrame(_grow(int(pdf["tree"].iloc[0]), X, max_depth),
                                columns=["tree", "node", "feature", "threshold", "left", "right", "size",
                                         "leaf", "depth"])
        nodes = sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
        return IsolationForestModel(nodes, psi)


class IsolationForestModel(StoredModel):
    def __init__(self, nodes: pd.DataFrame, psi: int):
        super().__init__()
        self.psi = psi
        trees = []
        for _, g in nodes.sort_values(["tree", "node"]).groupby("tree"):
            trees.append({k: g[k].to_numpy() for k in ("feature", "threshold", "left", "right", "size",
                                                         "leaf", "depth")})
        self.trees = trees

    def _state(self) -> dict:
        return {"psi": self.psi, "trees": [{k: v.tolist() for k, v in t.items()} for t in self.trees]}

    @classmethod
    def _rebuilt(cls, state: dict, tables: dict) -> "IsolationForestModel":
        rows = [pd.DataFrame(t).assign(tree=i, node=range(len(t["leaf"]))) for i, t in enumerate(state["trees"])]
        return cls(pd.concat(rows, ignore_index=True), state["psi"])

    def _scores(self, x: np.ndarray) -> np.ndarray:
        """One anomaly score per row (as a column)."""
        total = np.zeros(len(x))
        for t in self.trees:
            node = np.zeros(len(x), dtype=int)
            active = ~t["leaf"][node]
            while active.any():
                f = t["feature"][node[active]]
                go_left = x[active, f] < t["threshold"][node[active]]
                node[active] = np.where(go_left, t["left"][node[active]], t["right"][node[active]])
                active = ~t["leaf"][node]
            total += t["depth"][node] + c_factor(t["size"][node])
        norm = float(c_factor([self.psi])[0])
        return np.power(2.0, -(total / max(len(self.trees), 1)) / norm)[:, None]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        cols = [c for c in dataset.columns if c not in ("prediction", "anomaly_score")]
        out = dataset.select(*cols, features_udf(self._scores, F.col("features"))[0].alias("anomaly_score"))
        return out.withColumn("prediction", F.when(F.col("anomaly_score") > 0.5, -1.0).otherwise(1.0))
