"""Onset profile: steps that fit equally well are equal, so the first one is taken."""

from __future__ import annotations

from skyrill.functions import models as M
from skyrill.operators.selection import profile_onset
from skyrill.plans.catalog import CANDIDATES


def test_curve_through_all_points_takes_the_first_step(spark):
    points = [(0.0, 1.0, 0.12), (1.3579115070097032, 0.879021879021879, 0.052741312741312746)]
    rows = [(o, "i", t, y + o * 1e-3, s, False, 3 * s) for o in range(40) for t, y, s in points]
    df = spark.createDataFrame(rows, "object long, band string, t double, y double, s double, is_upper boolean, ceiling double")
    got = profile_onset(df, M.MODELS["Bazin"], CANDIDATES["Bazin"]).collect()
    assert len(got) == 40 and {r.t0 for r in got} == {-30.0}
