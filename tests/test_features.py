"""Interpolation and percentiles against plain versions."""

from __future__ import annotations

import random

import numpy as np

from skyrill.operators import features as feat
from skyrill.operators import ml


def test_interpolation_equals_numpy(spark):
    rng = random.Random(2)
    points, questions = [], []
    for o in range(30):
        ts = sorted(rng.sample(range(60), rng.randint(1, 12)))
        points += [(o, float(t), rng.gauss(0, 1)) for t in ts]
        questions += [(o, rng.choice([float(rng.choice(ts)), rng.uniform(-10, 70)])) for _ in range(15)]
    questions += [(99, 1.0)]
    curve = spark.createDataFrame(points, "object long, t double, m double").repartition(3)
    got = feat.interpolate(curve, spark.createDataFrame(questions, "object long, q double")).collect()
    assert len(got) == len(questions) - 1
    for r in got:
        xs = [(t, m) for o, t, m in points if o == r.object]
        assert abs(r.value - np.interp(r.q, *zip(*xs))) < 1e-12


def test_interpolation_is_one_sort_of_the_given_rows(spark):
    """No join and no product of points and questions: a single shuffle by object."""
    curve = spark.range(20_000).selectExpr("id % 2 as object", "cast(id as double) as t", "cast(id as double) as m")
    asked = spark.range(20_000).selectExpr("id % 2 as object", "id + 0.5 as q")
    out = feat.interpolate(curve, asked)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Exchange") == 1
    assert out.where("abs(value - least(greatest(q, object), 19998.0 + object)) < 1e-9").count() == 20_000


def test_index_percentiles(spark):
    rng = random.Random(4)
    groups = {k: [rng.choice([None, rng.randrange(9)]) for _ in range(rng.randint(1, 30))] for k in range(40)} | {99: [None, None]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k long, v long")
    got = {r.k: r for r in feat.index_percentiles(df, ["k"], "v").collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        s = sorted(v for v in vs if v is not None)
        want = [s[int(len(s) * p)] if s else None for p in (0.16, 0.5, 0.84)]
        assert [got[k].p16, got[k].p50, got[k].p84] == want


def test_folds(spark):
    """Sizes differ by one in each class, a null class too; folds do not depend on the partitioning."""
    rows = [(i, None if i % 10 == 9 else "abc"[min(i % 7, 2)]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, label string")
    first = {r.id: r.fold for r in ml.stratified_folds(df, "id", "label", 3).collect()}
    assert len(first) == 500 and first == {r.id: r.fold for r in ml.stratified_folds(df.repartition(5), "id", "label", 3).collect()}
    for c in ("a", "b", "c", None):
        n = [sum(1 for i, x in rows if x == c and first[i] == k) for k in range(3)]
        assert max(n) - min(n) <= 1
    assert ml.stratified_folds(df.limit(0), "id", "label", 3).count() == 0


def test_automatic_bins_equal_numpy(spark):
    from skyrill.operators.validate import histogram_auto

    rng = random.Random(6)
    for values in ([rng.gauss(0, 3) for _ in range(500)] + [float("nan"), None], [2.5] * 7):
        df = spark.createDataFrame([(x,) for x in values], "x double")
        got = histogram_auto(df, df["x"]).orderBy("bin").collect()
        n, edges = np.histogram([x for x in values if x is not None and x == x], bins=25)
        assert [r.n for r in got] == list(n) and np.allclose([r.low for r in got], edges[:-1]) and np.allclose([r.high for r in got], edges[1:])
    empty = spark.createDataFrame([(None,)], "x double")
    assert histogram_auto(empty, empty["x"]).count() == 0
