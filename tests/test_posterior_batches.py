"""Posterior curves of many bands are made some bands at a time, each from its own draws."""

from __future__ import annotations

import numpy as np

from skyrill.functions.models import MODELS
from skyrill.operators import fitters, search


def test_posterior_curves_in_batches_equal_single_ones(spark):
    model = MODELS["Bazin"]
    mu = np.array([0.0, 0.1, 3.0, 0.7, 3.0, -3.0])
    params = spark.createDataFrame([(str(o), "g", model.name, p, float(m), 0.05) for o in range(30) for p, m in zip(model.params, mu)], "object string, band string, model string, param string, svi_mean double, svi_std double")
    spans = spark.createDataFrame([(o, "g", 0.0, 20.0 + o, 5.0) for o in range(30)], "object long, band string, t_min double, t_max double, peak double")
    out = fitters.posterior_curves(params, spans, points=8)
    plan = out._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "FlatMapGroups" not in plan
    rows = out.toPandas().sort_values(["object", "t"])
    assert len(rows) == 240
    for o in ("0", "17", "29"):
        mine = rows[rows.object == o]
        rng = np.random.Generator(np.random.PCG64(fitters.seed_of(o, "g", "posterior")))
        want = search.posterior_bands(model, mu, np.full(6, 0.05), np.linspace(0, 20 + int(o), 8), 5.0, 23.9, rng)
        np.testing.assert_allclose(mine[["p16", "p50", "p84"]].to_numpy().T, want)
