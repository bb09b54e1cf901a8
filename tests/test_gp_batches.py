"""GP features of many bands: made some bands at a time, equal to fits of each band alone, with few solves."""

from __future__ import annotations

import numpy as np

from skyrill.operators import fitters, gp


def _curve(o: int, b: str, n: int):
    rng = np.random.default_rng(o * 7 + ord(b))
    t = np.sort(rng.uniform(0, 30, n))
    return t, 18 + (t - 12) ** 2 / 90 + rng.normal(0, 0.05, n), rng.uniform(0.02, 0.08, n)


def test_bands_in_batches_equal_single_fits(spark):
    curves = {(o, b): _curve(o, b, 4 + (o + ord(b)) % 30) for o in range(100) for b in "gr"}
    rows = [(o, b, *map(float, p)) for (o, b), c in curves.items() for p in zip(*c)]
    df = spark.createDataFrame(rows, "object long, band string, t double, value double, value_err double")
    fit = fitters.fit_gp(df, "B")
    plan = fit._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "FlatMapGroups" not in plan
    got = {(int(r.object), r.band): r for r in fit.collect()}
    assert set(got) == {k for k, c in curves.items() if len(c[0]) >= 5}
    for k in list(got)[::17]:
        o = [c[0] for (x, _), c in curves.items() if x == k[0]]
        want = gp.fit_band(*curves[k], (min(t.min() for t in o), max(t.max() for t in o)), "B")
        assert all(np.isnan(x) if got[k][c] is None else np.isclose(got[k][c], x, equal_nan=True) for c, x in want.items())


def test_only_candidates_whose_deviation_counts_are_solved(monkeypatch):
    solved, solve = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: solved.append(len(a)) or solve(a, b))
    t, m, e = _curve(1, "g", 25)
    gp.fit_band(t, m, e, (0.0, 30.0), "A")
    # Two for the weights, then one candidate's grid, points and forecast.
    assert len(solved) == 5 and solved[2:] == [1, 1, 1]
