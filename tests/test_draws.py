from __future__ import annotations

import math

from pyspark.sql import functions as F

from skyrill.functions.draws import normal, uniform


def test_moments_and_independence(spark):
    n = 100_000
    z = [normal(F.col("id"), 42, k) for k in range(4)]
    df = spark.range(n).select(*[x.alias(f"z{k}") for k, x in enumerate(z)], normal(F.col("id"), 43).alias("other"), uniform(F.col("id"), 42, 7).alias("u"))
    r = df.agg(*[g(f"z{k}").alias(f"{name}{k}") for k in range(4) for name, g in (("mean", F.avg), ("var", F.var_pop), ("skew", F.skewness), ("kurt", F.kurtosis))], *[F.corr("z0", c).alias(f"c_{c}") for c in ("z1", "z2", "z3", "other")], F.min("u").alias("low"), F.max("u").alias("high"), F.avg("u").alias("mean_u")).first()
    e = 5 / math.sqrt(n)
    for k in range(4):
        assert abs(r[f"mean{k}"]) < e and abs(r[f"var{k}"] - 1) < 2 * e and abs(r[f"skew{k}"]) < 3 * e and abs(r[f"kurt{k}"]) < 6 * e
    assert all(abs(r[f"c_{c}"]) < e for c in ("z1", "z2", "z3", "other"))
    assert 0 < r.low < 0.001 and 0.999 < r.high < 1 and abs(r.mean_u - 0.5) < e


def test_same_on_any_partitioning(spark):
    one = spark.range(500).repartition(7).select("id", normal(F.col("id"), 1).alias("z"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, spark.range(500).coalesce(1).select("id", normal(F.col("id"), 1)).collect()))
