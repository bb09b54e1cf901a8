"""The folded kilonova against the stacked one in numpy."""

from __future__ import annotations

import random

import numpy as np
import pytest

from skyrill.functions.kilonova import kilonova, with_kilonova
from skyrill.functions.models import MODELS, gradient_numpy
from skyrill.operators import fitters


@pytest.mark.parametrize("theta", [(-2.0, -0.7, 0.5, 0.0), (-3.0, -0.5, 2.0, 1.0), (-0.5, -2.0, -1.0, -2.0), (-1.2, -1.1, 1.0, 40.0)])
def test_equals_numpy(spark, theta):
    rng = random.Random(1)
    rows = [(o, rng.choice([rng.uniform(-5, 30), float(rng.randint(-2, 20)), 0.005])) for o in range(12) for _ in range(o + 1)] + [(None, 3.0), (None, 5.0), (50, -9.0)]
    out = with_kilonova(spark.createDataFrame(rows, "object long, t double"), ["object"], theta, "flux").collect()
    assert len(out) == len(rows)
    for o in {o for o, _ in rows}:
        ts = sorted(t for x, t in rows if x == o)
        got = sorted((r.t, r.flux) for r in out if r.object == o)
        want = kilonova(np.array([theta]), np.array(ts))[0]
        assert np.allclose([f for _, f in got], want, rtol=1e-7, atol=1e-9)


def test_gradient_equals_numpy(spark):
    theta = (-2.0, -0.7, 0.5, 0.0)
    spans = spark.createDataFrame([(1, -1.0, 20.0), (2, -1.0, 3.0)], "object long, t_min double, t_max double")
    rows = fitters.kilonova_gradients(spans, theta, 12).orderBy("object", "t").collect()
    for o, end in ((1, 20.0), (2, 3.0)):
        mine = [r for r in rows if r.object == str(o)]
        f, g = gradient_numpy(MODELS["MetzgerKN"], np.array([[*theta, -3.0]]), np.linspace(-1.0, end, 12))
        assert np.allclose([r.flux for r in mine], f[0], rtol=1e-7, atol=1e-9)
        assert np.allclose([[r[f"d_{n}"] for n in MODELS["MetzgerKN"].params[:4]] for r in mine], g[0, :, :4], atol=1e-3)


def test_curves_of_many_groups_meet_their_rows_in_one_join_without_a_broadcast(spark):
    spans = spark.range(1500).selectExpr("id as object", "-1.0D as t_min", "1.0D + id / 50 as t_max")
    theta = (-2.0, -0.7, 0.5, 0.0)
    out = fitters.kilonova_gradients(spans, theta, 4)
    rows = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.split("== Initial Plan ==")[0].count("SortMergeJoin") == 1
    curves: dict = {}
    for r in rows:
        curves.setdefault(int(r.object), []).append((r.t, r.flux))
    assert len(curves) == 1500
    for o in (0, 1023, 1024, 1499):
        t, flux = map(np.array, zip(*sorted(curves[o])))
        np.testing.assert_allclose(flux, kilonova(np.array([theta]), t)[0], rtol=1e-9, atol=1e-12)
