from __future__ import annotations

import math

import numpy as np
import pytest

from skyrill.operators.ml import stratified_split
from skyrill.operators import quantile
from skyrill.operators.quantile import column_quantiles, quantile_by


@pytest.mark.parametrize("q", [0.5, 0.98, 0.0, 1.0, 0.25])
def test_equals_numpy(spark, q):
    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(size=30_000), "b": rng.integers(0, 3, 999).astype(float), "c": np.array([4.0]), "d": np.array([1.0, 2.0]), "e": np.arange(7.0), None: np.full(50, 2.5)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("z", None)]
    got = {r.g: r.m for r in quantile_by(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", "m", q).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert math.isclose(got[k], np.quantile(v, q), rel_tol=1e-12, abs_tol=1e-12), k


def test_without_keys_and_without_rows(spark):
    df = spark.range(1, 101)
    assert quantile_by(df, [], "id", "m").first().m == 50.5
    assert quantile_by(df.limit(0), ["id"], "id", "m").count() == 0


def test_every_class_has_training_rows(spark):
    rows = spark.createDataFrame([(i, "big" if i > 2 else f"rare{i}") for i in range(4000)], "id long, c string")
    n = {(r.c, r.train): r["count"] for r in stratified_split(rows, "id", "c").groupBy("c", "train").count().collect()}
    assert all(n.get((f"rare{i}", True)) == 1 for i in range(3))
    assert 0.72 < n["big", True] / 3997 < 0.78


@pytest.mark.parametrize("q", [0.5, 0.98, 0.0, 1.0])
@pytest.mark.parametrize("few", [10, 1_000_000])
def test_columns_equal_numpy(spark, q, few, monkeypatch):
    """Bounds are narrowed again where much is left between them; ties are not cut."""
    monkeypatch.setattr(quantile, "FEW", few)
    rng = np.random.default_rng(9)
    n = 20_000
    columns = {"a": rng.normal(size=n), "b.c": rng.integers(0, 3, n).astype(float), "d": np.where(np.arange(n) < 5, 1.0, np.nan), "e": np.full(n, np.nan), "f": np.r_[np.full(n // 2, 7.0), rng.normal(size=n - n // 2)]}
    df = spark.createDataFrame(list(zip(*[[None if math.isnan(x) else float(x) for x in v] for v in columns.values()])), ", ".join(f"`{c}` double" for c in columns))
    got = column_quantiles(df, list(columns), q)
    for c, v in columns.items():
        v = v[~np.isnan(v)]
        assert got[c] is None if not len(v) else math.isclose(got[c], np.quantile(v, q), rel_tol=1e-12, abs_tol=1e-12), c
    assert column_quantiles(df, [], q) == {} and column_quantiles(df.limit(0), ["a"], q) == {"a": None}
