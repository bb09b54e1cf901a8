"""Gaussian processes are fitted to every point of a band, however long it is."""

from __future__ import annotations

import numpy as np
import pytest

from skyrill.operators import gp


def _dipped(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A flat curve that is bright only between the points that thinning would keep (of 100: ranks 2, 6, 10, ...)."""
    t, mag = np.linspace(0, 30, n), np.full(n, 20.0)
    mag[[k for k in (n // 2 - 3, n // 2 - 2, n // 2 - 1, n // 2 + 1) if k not in gp.thin(n)]] -= 3
    return t, mag, np.full(n, 0.05)


@pytest.mark.parametrize("backend", ["A", "B"])
@pytest.mark.parametrize("n", [50, 100])
def test_points_between_kept_ranks_count(backend, n):
    t, mag, err = _dipped(n)
    row = gp.fit_band(t, mag, err, (0.0, 30.0), backend)
    assert abs(row["t0_days"] - 15) < 2.5 and row["gp_peak_to_peak"] > 0.5


def test_long_bands_equal_dense_systems():
    rng = np.random.default_rng(4)
    n = 300
    t = np.sort(rng.uniform(0, 40, n))
    t[100] = t[101]
    y = 19 + np.sin(t / 3) + rng.normal(0, 0.05, n)
    tried = [(a, 40 / d, v) for a in gp.AMPLITUDES for d in gp.LENGTH_DIVISORS for v in (1e-4, 3e-3)]
    columns = tuple(map(np.array, zip(*tried)))
    dense, long = gp.Fits(t, y, *columns, normalise=True), gp.solved(t, y, tried, (0.0, 40.0))
    assert isinstance(long, gp.LongFits)
    at = np.linspace(-1, 43, 70)
    for have, want in zip(long.predict(at), dense.predict(at)):
        np.testing.assert_allclose(have, want, rtol=1e-6, atol=1e-6)
    np.testing.assert_allclose(long.means(t), dense.means(t), rtol=1e-7)
    np.testing.assert_allclose(long.predict(at, slice(5, 6))[1], dense.predict(at, slice(5, 6))[1], rtol=1e-6, atol=1e-6)


def test_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    t = np.sort(rng.uniform(0, 20, 500))
    mag, err = 18 + (t - 8) ** 2 / 50 + rng.normal(0, 0.05, 500), rng.uniform(0.02, 0.08, 500)
    want = gp.fit_band(t, mag, err, (0.0, 20.0), "B")
    monkeypatch.setattr(gp, "BLOCK", 64)
    have = gp.fit_band(t, mag, err, (0.0, 20.0), "B")
    assert all(np.isclose(have[k], want[k], rtol=1e-6, atol=1e-9, equal_nan=True) for k in want)


def test_features_are_never_more_than_points():
    """Lengths that are short for the range need many features; then points are fewer and are solved as they are."""
    t = np.linspace(0, 5000, 200)
    assert isinstance(gp.solved(t, np.sin(t), [(0.2, 12.0, 1e-3)], (0.0, 5000.0)), gp.Fits)
    assert isinstance(gp.solved(t, np.sin(t), [(0.2, 400.0, 1e-3)], (0.0, 5000.0)), gp.LongFits)
