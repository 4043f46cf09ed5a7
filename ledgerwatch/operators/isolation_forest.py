"""Isolation Forest (Liu, Ting, Zhou 2008). Trees are grown from fixed-size samples, so the forest's
size does not depend on the data; scoring is a vectorised pass without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, depth double"


def expected_depth(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grower(sample_size: int, seed: int):
    limit = int(np.ceil(np.log2(max(sample_size, 2))))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        ordered = group.sort_values("id")
        data = np.vstack(ordered["x"].to_numpy())
        rng = np.random.default_rng([seed, tree])
        nodes = []
        waiting = [(np.arange(len(data)), 0, None, None)]
        while waiting:
            rows, depth, parent, side = waiting.pop()
            me = len(nodes)
            if parent is not None:
                nodes[parent][side] = me
            part = data[rows]
            low, high = part.min(axis=0), part.max(axis=0)
            open_features = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or not len(open_features):
                nodes.append([tree, me, -1, 0.0, me, me, depth + expected_depth(len(rows))])
                continue
            feature = int(rng.choice(open_features))
            threshold = float(rng.uniform(low[feature], high[feature]))
            nodes.append([tree, me, feature, threshold, -1, -1, 0.0])
            left = part[:, feature] <= threshold
            waiting.append((rows[~left], depth + 1, me, 5))
            waiting.append((rows[left], depth + 1, me, 4))
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "depth"])

    return grow


def fit(points: DataFrame, trees: int = 200, sample_size: int = 256, seed: int = 42, pool_size: int | None = None) -> DataFrame:
    """Node table of the forest. ``points``: id, x (array of doubles).

    Each tree draws ``sample_size`` rows from one uniform pool, taken by the smallest hash values over all rows.
    ``pool_size`` bounds the rows that all trees see together and that are sent to every executor; by default
    it grows with the forest, to a quarter of what trees would take without sharing rows.
    """
    pool_size = pool_size or max(sample_size, trees * sample_size // 4)
    pool = cut_lineage(points.select("id", "x").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(pool_size))
    draw = Window.partitionBy("tree").orderBy(F.xxhash64("tree", "id"), "id")
    drawn = (
        pool.select("id")
        .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .withColumn("_place", F.row_number().over(draw))
        .where(F.col("_place") <= sample_size)
        .select("tree", "id")
    )
    samples = drawn.join(F.broadcast(pool), "id")  # at most pool_size rows
    return samples.groupBy("tree").applyInPandas(_grower(sample_size, seed), NODE_SCHEMA)


@dataclass
class Forest:
    """The grown trees as arrays, padded to one width: at most 200 x 511 nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    sample_size: int

    @staticmethod
    def load(nodes: DataFrame, sample_size: int = 256) -> "Forest":
        table = nodes.toPandas().sort_values(["tree", "node"])
        trees, width = table["tree"].nunique(), int(table["node"].max()) + 1
        arrays = {}
        for column, kind, empty in (("feature", int, -1), ("threshold", float, 0), ("left", int, 0), ("right", int, 0), ("depth", float, 0)):
            filled = np.full((trees, width), empty, dtype=kind)
            filled[table["tree"], table["node"]] = table[column]
            arrays[column] = filled
        return Forest(**arrays, sample_size=sample_size)

    def score(self, spark: SparkSession, x: Column | str) -> Column:
        """Anomaly score in (0, 1]: the higher, the easier a row is isolated."""
        shared = spark.sparkContext.broadcast(
            (self.feature, self.threshold, self.left, self.right, self.depth)
        )
        normal = expected_depth(self.sample_size)
        steps = int(np.ceil(np.log2(max(self.sample_size, 2)))) + 1

        @F.pandas_udf("double")
        def anomaly(batch: pd.Series) -> pd.Series:
            feature, threshold, left, right, depth = shared.value
            data = np.vstack(batch.to_numpy())
            rows = np.arange(len(data))
            total = np.zeros(len(data))
            for t in range(len(feature)):
                node = np.zeros(len(data), dtype=int)
                for _ in range(steps):
                    split = feature[t][node]
                    goes_left = data[rows, np.maximum(split, 0)] <= threshold[t][node]
                    node = np.where(split < 0, node, np.where(goes_left, left[t][node], right[t][node]))
                total += depth[t][node]
            return pd.Series(2.0 ** (-(total / len(feature)) / normal))

        return anomaly(x)
