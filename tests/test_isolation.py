"""The isolation forest against a version of plain loops over the same hashes."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from skyrill.operators import isolation as I


def plain_scores(points, hashes, n_trees, size, seed):
    """{key: score}: nested lists as trees, one row walked at a time."""

    def build(ids, tree, node, depth, limit):
        able = [c for c in range(2) if len({points[i][c] for i in ids}) > 1]
        if depth >= limit or not able:
            return depth + I.average_path(len(ids))
        c = able[int(I.uniform(seed, tree, node, 0) * len(able))]
        low, high = min(points[i][c] for i in ids), max(points[i][c] for i in ids)
        cut = low + I.uniform(seed, tree, node, 1) * (high - low)
        sides = [i for i in ids if points[i][c] < cut], [i for i in ids if points[i][c] >= cut]
        return c, cut, *(build(side, tree, 2 * node + 1 + k, depth + 1, limit) for k, side in enumerate(sides))

    def path(tree, x):
        while isinstance(tree, tuple):
            tree = tree[2 + (x[tree[0]] >= tree[1])]
        return tree

    forest = []
    for t in range(n_trees):
        ids = sorted(points, key=lambda i: hashes[i, t])[:size]
        forest.append(build(ids, t, 0, 0, math.ceil(math.log2(len(ids)))))
    n = min(size, len(points))
    return {i: 2 ** -(sum(path(t, x) for t in forest) / n_trees / I.average_path(n)) for i, x in points.items()}


@pytest.mark.parametrize("n,size", [(400, 64), (40, 64)])
def test_scores_equal_plain_loops(spark, n, size):
    rng = random.Random(n)
    points = {i: (rng.gauss(0, 1), round(rng.gauss(0, 1), 1)) for i in range(n)} | {n: (9.0, 9.0), n + 1: (-8.0, 7.0)}
    df = spark.createDataFrame([(i, *x) for i, x in points.items()], "id long, a double, b double").repartition(3)
    trees = 20
    hashed = df.select("id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("t")).select("id", "t", F.xxhash64("id", "t", F.lit(5)).alias("h"))
    hashes = {(r.id, r.t): r.h for r in hashed.collect()}
    want = plain_scores(points, hashes, trees, size, 5)
    got = {r.id: r for r in I.outliers(df, "id", ["a", "b"], 0.02, trees, size, 5).collect()}
    assert len(got) == len(points)
    for i in points:
        assert got[i].score == pytest.approx(want[i], abs=1e-9)
    ranked = sorted(points, key=lambda i: -got[i].score)
    assert set(ranked[:2]) == {n, n + 1} and got[n].outlier
    assert sum(r.outlier for r in got.values()) == math.ceil(0.02 * (len(points) - 1))


def test_odd_tables(spark):
    kind = "id long, a double, b double"
    assert I.outliers(spark.createDataFrame([], kind), "id", ["a", "b"]).count() == 0
    same = spark.createDataFrame([(i, 1.0, None) for i in range(50)] + [(50, 1.0, float("nan"))], kind)
    rows = I.outliers(same, "id", ["a", "b"], trees=5).collect()
    assert len(rows) == 51 and {(r.score, r.outlier) for r in rows} == {(0.5, False)}
    two = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 4.0)], kind)
    assert [r.score for r in I.outliers(two, "id", ["a", "b"], trees=5).collect()] == [0.5, 0.5]
