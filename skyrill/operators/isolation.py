"""Isolation forest: rows that random splits set apart early are outliers.

Each tree is grown on a small sample of rows, the ones of least hash for that tree. One
scan keeps, for each row, the trees whose threshold its hashes pass, so what is
shuffled is about ``TREES * SAMPLE`` rows at any input size; a tree's rows meet
in one group of bounded size. Splits are drawn from a hash of (seed, tree,
node), so a forest depends on its rows and its seed alone. All rows are then
scored where they lie: the forest is a bounded table, and each row walks all its
trees at once.

Defined results: a missing or infinite value counts as 0; rows equal in all
columns have equal scores; a table of at most two rows has scores of 0.5; an
empty one gives an empty one; equal scores are all in or all out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..sources.scratch import staged
from .quantile import column_quantiles

#: Trees, rows of a tree's sample, share of outliers and seed of the usual forest.
TREES = 100
SAMPLE = 256
SHARE = 0.02
SEED = 42
_MASK = (1 << 64) - 1


def uniform(*parts: int) -> float:
    """A number in [0, 1) of whole numbers: rounds of a 64-bit mixing function."""
    x = 0x9E3779B97F4A7C15
    for p in parts:
        x = (x ^ (p & _MASK)) * 0xBF58476D1CE4E5B9 & _MASK
        x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
        x ^= x >> 31
    return (x >> 11) / (1 << 53)


def average_path(n: int) -> float:
    """Mean depth at which a search tree of ``n`` keys ends without a hit: what an unsplit leaf still has before it."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def samples(rows: DataFrame, key: str, columns: list[str], trees: int = TREES, size: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(tree, h, columns): of each tree the ``size`` rows of least hash of (key, tree, seed), all rows if there are fewer."""
    n = rows.count()
    # Far more than enough pass with certainty: the count of those that pass strays by few roots of the expected one.
    expected = size + 10 * math.sqrt(size) + 50
    cut = (1 << 63) - 1 if n <= expected else int(expected / n * 2**64) - 2**63
    passing = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.col(key), t, F.lit(seed)).alias("h"))), lambda s: s["h"] <= cut)
    each = rows.select(F.explode(passing).alias("s"), *columns).select("s.tree", "s.h", *columns)
    order = Window.partitionBy("tree").orderBy("h", *columns)
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).drop("place")


def grow(x: np.ndarray, tree: int, seed: int = SEED) -> list[tuple[int, int, float, float]]:
    """Nodes (node, column, threshold, path) of a tree over the rows of ``x``; children of node i are 2 i + 1 and 2 i + 2, a leaf's column is -1.

    A column that varies in the node is drawn, then a threshold between its ends; rows below it go left.
    """
    limit = math.ceil(math.log2(max(len(x), 2)))
    out, todo = [], [(0, 0, np.arange(len(x)))]
    while todo:
        node, depth, at = todo.pop()
        low, high = (x[at].min(axis=0), x[at].max(axis=0)) if len(at) else (np.zeros(x.shape[1]),) * 2
        able = np.flatnonzero(high > low)
        if depth >= limit or not len(able):
            out.append((node, -1, 0.0, depth + average_path(len(at))))
            continue
        column = int(able[int(uniform(seed, tree, node, 0) * len(able))])
        cut = float(low[column] + uniform(seed, tree, node, 1) * (high[column] - low[column]))
        below = x[at, column] < cut if cut > low[column] else x[at, column] <= low[column]
        out.append((node, column, cut if cut > low[column] else float(np.nextafter(low[column], np.inf)), 0.0))
        todo += [(2 * node + 1, depth + 1, at[below]), (2 * node + 2, depth + 1, at[~below])]
    return out


def fit(rows: DataFrame, key: str, columns: list[str], trees: int = TREES, size: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """The forest as rows (tree, n, node, column, threshold, path): n is the size of the tree's sample."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["h", *columns])
        tree = int(frame["tree"].iloc[0])
        nodes = pd.DataFrame(grow(frame[columns].to_numpy(float), tree, seed), columns=["node", "column", "threshold", "path"])
        return nodes.assign(tree=tree, n=len(frame))[["tree", "n", "node", "column", "threshold", "path"]]

    return samples(rows, key, columns, trees, size, seed).groupBy("tree").applyInPandas(one, "tree int, n int, node int, column int, threshold double, path double")


def walk(x: np.ndarray, column: np.ndarray, threshold: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Path lengths (rows, trees) of the rows of ``x`` in trees laid out as heaps (trees, nodes)."""
    out = np.zeros((len(x), len(column)))
    for t in range(len(column)):
        node = np.zeros(len(x), np.int64)
        while (inner := column[t, node] >= 0).any():
            at = np.flatnonzero(inner)
            n = node[at]
            node[at] = 2 * n + 1 + (x[at, column[t, n]] >= threshold[t, n])
        out[:, t] = path[t, node]
    return out


def score(rows: DataFrame, forest: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """``keep`` and ``score`` of every row: 2 to the power of minus its mean path over the expected one."""
    nodes = forest.collect()  # at most TREES * 2 * SAMPLE rows
    trees = sorted({r.tree for r in nodes})
    width = 1 + max((r.node for r in nodes), default=0)
    column, threshold, path = np.full((len(trees), width), -1), np.zeros((len(trees), width)), np.zeros((len(trees), width))
    place = {t: k for k, t in enumerate(trees)}
    for r in nodes:
        at = place[r.tree], r.node
        column[at], threshold[at], path[at] = r.column, r.threshold, r.path
    expected = average_path(nodes[0].n) if nodes else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[len(keep) :]], axis=1) if batch.num_rows else np.zeros((0, len(columns)))
            mean = walk(x, column, threshold, path).mean(axis=1) if len(trees) else np.zeros(len(x))
            value = np.round(2.0 ** -(mean / expected), 12) if expected > 0 and width > 1 and nodes[0].n > 2 else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(value)], [*keep, "score"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, *columns).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "score double"]))


def outliers(rows: DataFrame, key: str, columns: list[str], share: float = SHARE, trees: int = TREES, size: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(key, score, outlier) of every row: outliers have a score above the quantile 1 - ``share``."""
    clean = staged(rows.select(key, *[F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in columns]), "isolation")
    scored = staged(score(clean, fit(clean, key, columns, trees, size, seed), columns, key), "scores")
    cut = column_quantiles(scored, ["score"], 1 - share)["score"]
    return scored.select(key, "score", (F.col("score") > F.lit(cut)).alias("outlier"))
