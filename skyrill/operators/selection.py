"""Swarm objective of fixed candidates, deterministic model selection, fit quality and onset-time profile, all relational."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kilonova import with_kilonova
from ..functions.likelihood import VAR_FLOOR, cost_term, log_normal_cdf
from ..functions.models import MODELS, ColumnOps, Model
from ..functions.numeric import finite

REJECT = 1e99
ONSET_STEPS = 50


def candidate_costs(rows: DataFrame, candidates: dict[str, tuple[float, ...]]) -> DataFrame:
    """Mean objective of each object and band under each candidate's parameters (t0 relative to the first time).

    Rows: object, band, t, y, s, is_upper, ceiling. The candidates become columns of one aggregate, so
    the observations are neither joined nor repeated; only the integrated model's curve, one for each band, meets its rows by a join.
    """
    aggs = []
    for name, theta in candidates.items():
        model = MODELS[name]
        if model.flux is None:
            rows = with_kilonova(rows, ["object", "band"], theta, "__kilonova")
        pred = model.evaluate(ColumnOps, theta, F.col("t")) if model.flux else F.col("__kilonova")
        term = cost_term(pred, F.col("y"), F.col("s"), F.col("is_upper"), F.col("ceiling"), theta[-1])
        bad = F.max(F.when(finite(pred).isNull(), 1).otherwise(0))
        aggs.append(F.when(bad == 1, F.lit(REJECT)).otherwise(F.avg(term)).alias(name))
    wide = rows.groupBy("object", "band").agg(*aggs)
    return wide.unpivot(["object", "band"], list(candidates), "model", "cost")


def select_model(costs: DataFrame, order: list[str]) -> DataFrame:
    """The candidate of least cost; of equals the one earlier in ``order``."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    best = costs.groupBy("object", "band").agg(F.min(F.struct("cost", rank.alias("rank"), "model")).alias("b"))
    return best.select("object", "band", F.col("b.model").alias("model"), F.col("b.cost").alias("cost"))


def mag_chi2(rows: DataFrame, model: Model, theta: tuple[float, ...]) -> DataFrame:
    """Mean squared residual in magnitudes over points with positive flux and prediction; limits included."""
    pred = model.evaluate(ColumnOps, theta, F.col("t"))
    mag = lambda x: F.lit(-2.5) * F.log10(x)
    usable = (pred > 0) & (F.col("y") > 0)
    err = F.lit(1.0857) * F.col("s") / F.col("y")
    r = F.when(usable, (mag(F.col("y")) - mag(pred)) / err)
    return rows.groupBy("object", "band").agg(F.avg(r * r).alias("mag_chi2"), F.count(r).alias("n_used"))


def baseline_chi2(rows: DataFrame) -> DataFrame:
    """Mean squared deviation from the plain mean over the variance, and the root mean square."""
    w = Window.partitionBy("object", "band")
    d = F.col("mag") - F.avg("mag").over(w)
    r = rows.withColumn("d", d)
    return r.groupBy("object", "band").agg(F.avg(F.col("d") ** 2 / (F.col("mag_err") ** 2 + VAR_FLOOR)).alias("baseline_chi2"), F.sqrt(F.avg(F.col("d") ** 2)).alias("rms"))


def profile_onset(rows: DataFrame, model: Model, theta: tuple[float, ...]) -> DataFrame:
    """Onset time by profile likelihood on a grid of ``ONSET_STEPS`` times, with its half-width.

    The grid runs from 30 days before the first time to 5 days after the
    brightest point. Detections meet the grid by ``explode`` and are summed up at once: amplitude
    (and baseline, where the model has one) at every step come from weighted sums in closed form. The
    likelihood is that of the residuals, for which all points meet the solved steps again: sums of squares
    cancel where a curve goes through its points, and their rounding would choose among equal steps.
    """
    w = Window.partitionBy("object", "band")
    bright = F.min(F.struct((-F.col("y")).alias("y"), "t")).over(w)
    bounded = rows.withColumns({"lo": F.min("t").over(w) - 30.0, "hi": bright["t"] + 5.0, "var": F.col("s") ** 2 + F.lit(VAR_FLOOR + math.exp(2 * theta[-1]))})
    step = F.explode(F.sequence(F.lit(0), F.lit(ONSET_STEPS - 1)))

    free = {"log_a": F.lit(0.0), "t0": F.col("onset"), "b": F.lit(0.0)}
    shape = finite(model.evaluate(ColumnOps, [free.get(p, v) for p, v in zip(model.params, theta)], F.col("t")))
    onset = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (ONSET_STEPS - 1)
    g = bounded.withColumn("k", step).withColumn("onset", onset).withColumn("f", shape)
    use = ~F.col("is_upper") & F.col("f").isNotNull()
    total = lambda x: F.coalesce(F.sum(F.when(use, x)), F.lit(0.0))
    f, y, var = F.col("f"), F.col("y"), F.col("var")
    sums = {"w1": 1 / var, "wf": f / var, "wff": f * f / var, "wy": y / var, "wfy": f * y / var}
    solved = g.groupBy("object", "band", "k").agg(F.first("onset").alias("onset"), F.count(f).alias("n"), *[total(x).alias(n) for n, x in sums.items()]).where("n > 0")
    a0, b0 = math.exp(theta[0]), theta[model.params.index("b")] if "b" in model.params else 0.0
    if "b" in model.params:
        det = F.col("wff") * F.col("w1") - F.col("wf") ** 2
        safe = F.when(F.abs(det) > 1e-20, det)
        a, b = (F.col("wfy") * F.col("w1") - F.col("wf") * F.col("wy")) / safe, (F.col("wff") * F.col("wy") - F.col("wf") * F.col("wfy")) / safe
        ok = F.coalesce(a > 1e-10, F.lit(False))
        amp, base = F.when(ok, a).otherwise(a0), F.when(ok, b).otherwise(b0)
    else:
        a = F.col("wfy") / F.when(F.col("wff") > 1e-20, F.col("wff"))
        amp, base = F.when(F.coalesce(a > 1e-10, F.lit(False)), a).otherwise(a0), F.lit(0.0)
    solved = solved.withColumns({"a": amp, "b": base})
    # A band's solved steps and its points are two arrays of one row: neither side is computed twice, and every step adds its points in one order.
    steps = solved.groupBy("object", "band").agg(F.collect_list(F.struct("k", "onset", "a", "b")).alias("steps"))
    points = bounded.groupBy("object", "band").agg(F.collect_list(F.struct("t", "y", "is_upper", "ceiling", "var")).alias("points"))
    each = steps.join(points, ["object", "band"]).select("object", "band", F.explode("steps").alias("e"), "points").select("object", "band", "e.*", F.explode("points").alias("u"))
    each = each.select("object", "band", "k", "onset", "a", "b", "u.*").withColumn("f", shape)
    p = F.col("a") * F.col("f") + F.col("b")
    limit = log_normal_cdf((F.col("ceiling") - p) / F.sqrt("var"))
    term = F.when(F.col("f").isNotNull(), F.when(F.col("is_upper"), limit).otherwise(-0.5 * ((p - y) * (p - y) / var + F.log(2 * math.pi * var))))
    ll = each.groupBy("object", "band", "k").agg(F.sum(term).alias("ll"), F.first("onset").alias("onset"))
    top = ll.withColumn("best", F.max("ll").over(w))
    near = F.when(F.col("ll") >= F.col("best") - 0.5, F.col("onset"))
    out = top.groupBy("object", "band").agg(F.min(F.struct((-F.col("ll")).alias("x"), "k", "onset")).alias("b"), F.min(near).alias("t_lo"), F.max(near).alias("t_hi"))
    return out.select("object", "band", F.col("b.onset").alias("t0"), (-F.col("b.x")).alias("log_likelihood"), F.greatest((F.col("t_hi") - F.col("t_lo")) / 2, F.lit(0.01)).alias("t0_sigma"))
