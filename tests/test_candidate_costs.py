"""Costs of candidates: the step that class_validation and confusion share."""

from __future__ import annotations

import math

import numpy as np

from skyrill.functions.kilonova import kilonova
from skyrill.functions.likelihood import VAR_FLOOR
from skyrill.operators import selection


def test_integrated_curves_meet_their_rows_without_a_broadcast(spark):
    """A curve is much wider than the row it is made from: a broadcast of all curves grows with the bands, and stops at some size."""
    theta = (-2.0, -0.7, 0.5, 0.0, -3.0)
    rows = spark.range(1200).selectExpr("id div 3 as object", "if(id % 3 = 0, null, 'g') as band", "id % 3 + id / 100 as t", "0.3D as y", "0.1D as s", "false as is_upper", "0.3D as ceiling")
    rows = rows.selectExpr("object", "band", "cast(t as double) as t", "y", "s", "is_upper", "ceiling").cache()
    out = selection.candidate_costs(rows, {"MetzgerKN": theta})
    got = {(r.object, r.band): r.cost for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.split("== Initial Plan ==")[0].count("SortMergeJoin") == 1
    curves: dict = {}
    for r in rows.collect():
        curves.setdefault((r.object, r.band), []).append(r.t)
    assert got.keys() == curves.keys() and len(got) == 800
    var = 0.1**2 + math.exp(2 * theta[-1]) + VAR_FLOOR
    for key, t in curves.items():
        pred = kilonova(np.array([theta]), np.array(t))[0]
        assert math.isclose(got[key], np.mean((pred - 0.3) ** 2 / var + math.log(var)), rel_tol=1e-7, abs_tol=1e-9)
