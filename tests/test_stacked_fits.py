"""Stacked fits: limits, padding and the table of heating change nothing, and little is computed that nobody asks for."""

from __future__ import annotations

import math

import numpy as np
import pytest

from skyrill.functions.kilonova import kilonova
from skyrill.functions.likelihood import log_normal_cdf_numpy
from skyrill.functions.models import MODELS, flux_numpy, gradient_numpy
from skyrill.operators import fitters, search


def _band(n: int, seed: int, limits: bool) -> search.Band:
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, 40, n))
    y = np.exp(-0.5 * ((t - 12) / 6) ** 2) + rng.normal(0, 0.02, n)
    s = np.full(n, 0.05)
    upper = (y / s < 3) & limits
    return search.Band(t, y / y.max(), s, upper, 3 * s)


def _thetas(model, rows: int, rng) -> np.ndarray:
    theta = np.tile(np.array(model.start, float), (rows, 1)) + rng.normal(0, 0.2, (rows, len(model.params)))
    theta[:, model.t0] = rng.uniform(-1, 1, rows) + (0 if model.flux is None else 8)
    return theta


def _likelihood(model, theta: np.ndarray, band: search.Band) -> float:
    """The log likelihood as it is printed."""
    pred = flux_numpy(model, theta[None], band.t)[0]
    if model.flux is None:
        pred = pred * min(max(1 / pred[~band.upper].max(), 0.1), 10.0)
    var = band.s**2 + math.exp(2 * theta[-1]) + 1e-10
    return float(np.where(band.upper, log_normal_cdf_numpy((band.ceiling - pred) / np.sqrt(var)), -0.5 * ((band.y - pred) ** 2 / var + np.log(2 * math.pi * var))).sum())


@pytest.mark.parametrize("model", MODELS.values(), ids=lambda m: m.name)
def test_costs_and_scores_with_limits(model):
    rng = np.random.default_rng(2)
    bands = [_band(n, n, True) for n in (7, 16, 23)]
    assert all(b.upper.any() and not b.upper.all() for b in bands)
    x = search.Stack(bands, [1, 2, 3])
    theta = np.stack([_thetas(model, 4, rng) for _ in bands])
    costs, (grad, _, fit) = search.cost(model, theta, x), search._score(model, theta, x)
    ll = search._likelihood(*fit, x)
    for i, band in enumerate(bands):
        for j in range(4):
            assert ll[i, j] == pytest.approx(_likelihood(model, theta[i, j], band), rel=1e-9)
            pred = flux_numpy(model, theta[i, j][None], band.t)[0]
            if model.flux is None:
                pred = pred * min(max(1 / pred[~band.upper].max(), 0.1), 10.0)
            var = band.s**2 + math.exp(2 * theta[i, j, -1]) + 1e-10
            each = np.where(band.upper, -log_normal_cdf_numpy((band.ceiling - pred) / np.sqrt(var)), (pred - band.y) ** 2 / var + np.log(var))
            assert costs[i, j] == pytest.approx(each.mean(), rel=1e-6)
            if model.flux is not None:
                _, slopes = gradient_numpy(model, theta[i, j][None], band.t)
                extra, sd = math.exp(2 * theta[i, j, -1]), np.sqrt(var)
                z = (band.ceiling - pred) / sd
                ratio = np.exp(-0.5 * z * z - 0.5 * math.log(2 * math.pi) - log_normal_cdf_numpy(z))
                want = (np.where(band.upper, -ratio / sd, (band.y - pred) / var)[:, None] * slopes[0]).sum(0)
                want[-1] = np.where(band.upper, -ratio * z * extra / var, ((band.y - pred) ** 2 / var - 1) * extra / var).sum()
                np.testing.assert_allclose(grad[i, j], want, rtol=1e-9, atol=1e-9)


def test_the_table_of_heating_gives_the_same_light():
    rng = np.random.default_rng(3)
    model = MODELS["MetzgerKN"]
    theta = rng.uniform(model.lower, model.upper, (6, 40, 5))
    t = np.sort(rng.uniform(-1, 60, (16, 6)), 0)
    have = search.flux(model, theta, t)
    want = kilonova(theta.reshape(-1, 5), np.repeat(t.T, 40, axis=0))
    np.testing.assert_allclose(have.reshape(16, -1).T, want, atol=2e-9)
    far = np.full((3, 6), 1e8) * np.arange(1, 4)[:, None]
    np.testing.assert_allclose(search.flux(model, theta, far).reshape(3, -1).T, kilonova(theta.reshape(-1, 5), np.repeat(far.T, 40, axis=0)), atol=2e-9)


def test_detections_cost_no_likelihood_of_limits(monkeypatch):
    asked = []
    monkeypatch.setattr(search, "log_normal_cdf_numpy", lambda z: asked.append(z.size) or log_normal_cdf_numpy(z))
    search.fit_band(_band(12, 1, False), 5, steps=3, only="Bazin")
    assert sum(asked) == 0


def test_rows_are_dealt_to_all_slots(spark, monkeypatch):
    rows = [(o, "g", *map(float, (b.t[i], b.y[i], b.s[i])), False, float(b.ceiling[i])) for o in range(12) for b in [_band(6, o, False)] for i in range(6)]
    df = spark.createDataFrame(rows, "object long, band string, t double, y double, s double, is_upper boolean, ceiling double")
    fit = fitters.fit_parametric(df, steps=2, only="Bazin")
    assert fit.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert fit.count() == 12 * 6
    monkeypatch.setattr(fitters, "FIT_ROWS", 9)
    assert fitters.fit_parametric(df, steps=2, only="Bazin").rdd.getNumPartitions() == 8
