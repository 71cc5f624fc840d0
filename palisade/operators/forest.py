"""Isolation forest: trees grown on small samples, scoring in vectorised batches.

Training reads the table once to draw a bounded pool; the work that grows with the data is
scoring, which needs no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade import constants as C
from palisade.operators.quantiles import exact_quantiles

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size int, depth int")
_EULER = 0.5772156649015329
_HASH_RANGE = 1 << 31
_SPARE = 2  # draw twice what a tree needs, so that a tree practically never runs short


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    long = 2.0 * (np.log(big - 1.0) + _EULER) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long))


def _share(wanted: int, have: int) -> int:
    return _HASH_RANGE if have <= wanted else int(_HASH_RANGE * wanted / have)


def tree_samples(rows: DataFrame, features: list[str], trees: int, subsample: int,
                 seed: int) -> DataFrame:
    """``tree`` and the features of its rows: the ``subsample`` smallest digests of each.

    ``seq`` decides every draw. A pool of fixed expected size is drawn first, with one hash
    per row; only pool rows are hashed per tree.
    """
    count = rows.count()
    pool_size = _SPARE * trees * subsample
    pool = rows.where(F.pmod(F.xxhash64(F.lit(seed), "seq"), F.lit(_HASH_RANGE))
                      < _share(pool_size, count))
    cut = _share(_SPARE * subsample, min(count, pool_size))
    drawn = pool.select(
        "seq", *features,
        F.explode(F.filter(
            F.sequence(F.lit(0), F.lit(trees - 1)),
            lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col("seq")), F.lit(_HASH_RANGE))
            < cut)).alias("tree"))
    order = Window.partitionBy("tree").orderBy("digest", "seq")
    return (
        drawn.withColumn("digest", F.pmod(F.xxhash64(F.lit(seed), "tree", "seq"),
                                          F.lit(_HASH_RANGE)))
        .withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= subsample)
        .select("tree", "nth", *features)
    )


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes of one tree as (node, feature, threshold, left, right, size, depth)."""
    nodes: list[tuple] = []
    todo = [(0, np.arange(len(x)), 0)]
    made = 1
    while todo:
        node, rows, depth = todo.pop()
        part = x[rows]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0))
        if depth >= limit or len(rows) <= 1 or not len(spread):
            nodes.append((node, -1, 0.0, -1, -1, len(rows), depth))
            continue
        feature = int(rng.choice(spread))
        values = part[:, feature]
        threshold = float(rng.uniform(values.min(), values.max()))
        below = values <= threshold
        nodes.append((node, feature, threshold, made, made + 1, len(rows), depth))
        todo.append((made + 1, rows[~below], depth + 1))
        todo.append((made, rows[below], depth + 1))
        made += 2
    return sorted(nodes)


def fit(rows: DataFrame, features: list[str], trees: int = C.FOREST_TREES,
        subsample: int = C.FOREST_SUBSAMPLE, seed: int = C.FOREST_SEED) -> DataFrame:
    """The forest as a node table; every task grows one tree from at most ``subsample`` rows."""
    limit = math.ceil(math.log2(subsample))
    names = list(features)

    def grow_tree(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        x = group.sort_values("nth")[names].to_numpy(float)
        grown = _grow(x, limit, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(grown, columns=["node", "feature", "threshold", "left", "right",
                                           "size", "depth"])
        out.insert(0, "tree", tree)
        return out

    return tree_samples(rows, names, trees, subsample, seed).groupBy("tree").applyInPandas(
        grow_tree, NODE_SCHEMA)


class Forest:
    """All trees in one set of arrays; child links count over the whole forest."""

    def __init__(self, nodes: pd.DataFrame, subsample: int = C.FOREST_SUBSAMPLE):
        nodes = nodes.sort_values(["tree", "node"])
        sizes = nodes.groupby("tree").size()
        self.roots = np.concatenate([[0], np.cumsum(sizes.to_numpy())[:-1]]).astype(np.int64)
        shift = np.repeat(self.roots, sizes.to_numpy())
        self.leaf = nodes["feature"].to_numpy() < 0
        self.feature = np.maximum(nodes["feature"].to_numpy(), 0).astype(np.int64)
        self.threshold = nodes["threshold"].to_numpy(float)
        here = np.arange(len(nodes))
        self.left = np.where(self.leaf, here, nodes["left"].to_numpy() + shift)
        self.right = np.where(self.leaf, here, nodes["right"].to_numpy() + shift)
        self.size = nodes["size"].to_numpy(float)
        self.depth = nodes["depth"].to_numpy(np.int64)
        self.height = self.depth + average_path(self.size)  # meaningful at leaves
        self.deepest = int(self.depth.max())
        self.norm = float(average_path(subsample))

    def path_length(self, x: np.ndarray) -> np.ndarray:
        """Mean path length over the trees, per row."""
        out = np.empty(len(x))
        for start in range(0, len(x), 4096):
            part = x[start:start + 4096]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            rows = np.arange(len(part))[:, None]
            for _ in range(self.deepest):
                goes_left = part[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(goes_left, self.left[at], self.right[at])
            out[start:start + 4096] = self.height[at].mean(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1); higher is more anomalous."""
        return np.power(2.0, -self.path_length(x) / self.norm)

    def expected_length(self, x: np.ndarray, known: tuple[int, ...]) -> np.ndarray:
        """Mean path length when only the ``known`` features are told.

        An unknown split follows both children by the share of training rows they got.
        """
        value = np.repeat(self.height[:, None], len(x), axis=1)
        is_known = np.isin(self.feature, known)
        for level in range(self.deepest - 1, -1, -1):
            inner = np.flatnonzero((self.depth == level) & ~self.leaf)
            told, untold = inner[is_known[inner]], inner[~is_known[inner]]
            if len(told):
                goes_left = x[:, self.feature[told]].T <= self.threshold[told][:, None]
                value[told] = np.where(goes_left, value[self.left[told]],
                                       value[self.right[told]])
            if len(untold):
                share = (self.size[self.left[untold]] / self.size[untold])[:, None]
                value[untold] = (share * value[self.left[untold]]
                                 + (1.0 - share) * value[self.right[untold]])
        return value[self.roots].mean(axis=0)


def load(nodes: DataFrame) -> Forest:
    """Node table to arrays; at most 511 rows per tree."""
    return Forest(nodes.toPandas())


def scored(rows: DataFrame, forest: Forest, features: list[str]) -> DataFrame:
    """Adds ``score``; no shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def forest_score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            yield pd.Series(shared.value.score(x))

    return rows.withColumn("score", forest_score(*[F.col(f) for f in features]))


def cut_score(scores: DataFrame, contamination: float = C.FOREST_CONTAMINATION) -> float:
    """The score above which the most anomalous ``contamination`` share lies.

    ``scores`` should be a written table, as the search may read it several times.
    """
    values = scores.select(F.lit("score").alias("name"), (-F.col("score")).alias("x"))
    return -exact_quantiles(values, {"score": [contamination]})["score"][0]


def predicted(scores: DataFrame, cut: float) -> DataFrame:
    """Adds ``prediction``: -1 for an anomaly, 1 otherwise."""
    return scores.withColumn("prediction", F.when(F.col("score") > cut, -1).otherwise(1))
