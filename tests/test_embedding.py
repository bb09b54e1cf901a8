"""The neighbour graph against brute force, weights against plain loops, and a layout that keeps clusters apart."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyrill.operators import embedding as E
from skyrill.sources.scratch import staged


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 12)) * 6
    x = np.concatenate([centres[i % 5] + rng.normal(size=12) for i in range(600)]).reshape(600, 12)
    x[200:230] = x[200]  # thirty copies
    df = spark.createDataFrame([(i, i % 5, *map(float, row)) for i, row in enumerate(x)], "name long, c long, " + ", ".join(f"x{k} double" for k in range(12)))
    return x, df


COLUMNS = [f"x{k}" for k in range(12)]


def test_neighbours_and_weights(spark, clusters):
    x, df = clusters
    points = staged(E._points(df, "name", COLUMNS), "test-points")
    edges = staged(E.nearest(points, 10, trees=3, block=48), "test-edges")
    name = {r.id: r.key for r in points.collect()}
    got: dict = {}
    for r in edges.collect():
        got.setdefault(name[r.id], {})[name[r.other]] = r.d
    assert set(got) == set(range(600)) and all(len(v) == 10 and i not in v for i, v in got.items())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    # Copies are at one distance: any of them is right.
    right = sum(d[i, j] <= np.sort(d[i])[9] + 1e-9 for i, v in got.items() for j in v)
    assert right / 6000 > 0.95 and E.recall(points, edges, 10, every=5) > 0.9
    assert all(math.isclose(d[i, j], v, abs_tol=1e-9) for i, vs in got.items() for j, v in vs.items())
    # Weights: each list adds up to the logarithm of its length; both sides are joined as probabilities.
    w = {}
    for i, v in got.items():
        dist = np.array(sorted(v.values()))
        if i < 3 and dist[0] > 0:
            gap = dist - dist[0]
            rates = np.geomspace(1e-4, 1e3, 200_000)[:, None]
            total = np.exp(-gap / rates).sum(axis=1)
            rate = rates[np.abs(total - math.log2(10)).argmin(), 0]
            w[i] = dict(zip(sorted(v, key=lambda j: (v[j], j)), np.exp(-gap / rate)))
    graph = {(name[r.a], name[r.b]): r.w for r in E.weights(edges).collect()}
    assert all(0 < x <= 1 + 1e-9 for x in graph.values()) and len(graph) == len({frozenset((i, j)) for i, v in got.items() for j in v})
    for i, mine in w.items():
        for j, one in mine.items():
            if i not in got[j]:
                assert math.isclose(graph.get((i, j), graph.get((j, i))), one, abs_tol=1e-3)


def test_clusters_stay_together(spark, clusters):
    _, df = clusters
    rows = E.embed(df, "name", COLUMNS, rounds=15).join(df.select("name", "c"), "name").collect()
    assert len(rows) == 600 and all(math.isfinite(r.u) and math.isfinite(r.v) for r in rows)
    at, c = np.array([(r.u, r.v) for r in rows]), np.array([r.c for r in rows])
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert (c[np.argsort(d, axis=1)[:, :10]] == c[:, None]).mean() > 0.95
    assert len({(round(r.u, 6), round(r.v, 6)) for r in rows}) > 400


def test_small_tables(spark):
    kind = "name long, a double, b double"
    assert E.embed(spark.createDataFrame([], kind), "name", ["a", "b"]).count() == 0
    assert E.embed(spark.createDataFrame([(1, 1.0, None)], kind), "name", ["a", "b"]).count() == 1
    three = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 2.0), (2, 3.0, float("nan")), (None, 5.0, 6.0)], kind)
    assert E.embed(three, "name", ["a", "b"], rounds=2).count() == 3


def test_groups_across_batches(spark):
    """Groups that go over several batches are whole, and points farther than a point asks for are left out."""
    rng = np.random.default_rng(9)
    rows = [(g, 100 * g + i, float("inf") if i % 2 else 1.0, [float(v) for v in rng.normal(size=3)]) for g in range(7) for i in range(1 + 5 * g)]
    df = spark.createDataFrame(rows, "g long, id long, w double, x array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        near = E._near(df, ["g"], 3)
        assert "FlatMapGroups" not in near._jdf.queryExecution().toString()
        got = {(r.id, r.other): r.d for r in near.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for g, i, w, x in rows:
        others = sorted((math.dist(x, y), j) for h, j, _, y in rows if h == g and j != i)[:3]
        want |= {(i, j): d for d, j in others if d <= w}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
