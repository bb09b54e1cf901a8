"""Features of a sampled curve: time scales, shape, interpolation, borrowed offsets, temperature and percentiles.

A curve is rows (object, t, m) with one row for each grid point; ``k`` numbers
them from 0 and ``n`` is their count (``indexed`` adds both).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("object",)


def indexed(curve: DataFrame) -> DataFrame:
    w = Window.partitionBy("object")
    return curve.withColumns({"k": F.row_number().over(w.orderBy("t")) - 1, "n": F.count(F.lit(1)).over(w)})


def grid(spans: DataFrame, points: int = 50) -> DataFrame:
    """``points`` equally spaced times from t_min to t_max of each row."""
    rows = spans.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return rows.withColumn("t", F.col("t_min") + (F.col("t_max") - F.col("t_min")) * F.col("k") / (points - 1))


def timescales(curve: DataFrame) -> DataFrame:
    """Rise and decay times, width at 0.75 below the peak, early and late slopes; null where undefined.

    The peak is the smallest magnitude, first of equals.
    """
    w = Window.partitionBy("object")
    c = indexed(curve).withColumn("p", F.min(F.struct("m", "k", "t")).over(w))
    k, n, pk, pm = F.col("k"), F.col("n"), F.col("p.k"), F.col("p.m")
    rise_base = F.when(pk > 1, F.avg(F.when(k < F.least(pk, F.lit(3)), F.col("m"))).over(w)).otherwise(pm + 0.5)
    end = F.least(F.floor((pk + n) / 2), n - 1)
    fall_base = F.sum(F.when((k > pk) & (k <= end), F.col("m"))).over(w) / F.greatest(end - pk, F.lit(1))
    c = c.withColumns({"rise_to": rise_base + (pm - rise_base) * (1 - math.exp(-1)), "fall_to": fall_base + (pm - fall_base) * math.exp(-1)})
    near = lambda to, side: F.min(F.when(side, F.struct(F.abs(F.col("m") - F.col(to)).alias("d"), "k", "t")))
    faint = F.col("m") >= pm + 0.75
    early = F.least(F.greatest(F.ceil(n * 0.25), F.lit(2)), n - 1)
    late = F.least(F.greatest(F.ceil(n * 0.25), F.lit(2)), n)
    slope = lambda side: F.regr_slope(F.when(side, F.col("m")), F.when(side, F.col("t")))
    g = c.groupBy("object").agg(
        F.first("p").alias("p"),
        F.count(F.lit(1)).alias("n"),
        near("rise_to", k < pk).alias("r"),
        near("fall_to", k > pk).alias("f"),
        F.max(F.when((k < pk) & faint, F.col("t"))).alias("before"),
        F.min(F.when((k > pk) & faint, F.col("t"))).alias("after"),
        slope(k < early).alias("early"),
        slope(k >= n - late).alias("late"),
    )
    return g.select(
        "object",
        F.col("p.t").alias("t_peak"),
        F.col("p.m").alias("peak"),
        (F.col("p.t") - F.col("r.t")).alias("rise_time"),
        (F.col("f.t") - F.col("p.t")).alias("decay_time"),
        (F.col("after") - F.col("before")).alias("fwhm"),
        F.when(F.col("n") >= 2, F.col("early")).alias("rise_rate"),
        F.when(F.col("n") >= 2, F.col("late")).alias("decay_rate"),
    )


def shape(curve: DataFrame) -> DataFrame:
    """Moments, extreme steps, ratio of last to peak, and sign changes of the second difference."""
    w = Window.partitionBy("object").orderBy("k")
    c = indexed(curve)
    first = lambda x: F.max(F.when(F.col("k") == x, F.col("t"))).over(Window.partitionBy("object"))
    c = c.withColumn("dt", first(1) - first(0))
    c = c.withColumns({"d1": (F.lead("m").over(w) - F.col("m")) / F.nullif("dt", F.lit(0.0)), "d2": (F.lead("m").over(w) - 2 * F.col("m") + F.lag("m").over(w)) / F.nullif(F.col("dt") * F.col("dt"), F.lit(0.0))})
    c = c.withColumn("next", F.lead("d2").over(w))
    turn = (F.abs("d2") > 1e-6) & (F.abs("next") > 1e-6) & (F.signum("d2") != F.signum("next"))
    g = c.groupBy("object").agg(
        F.stddev_pop("m").alias("sigma_f"),
        (F.max("m") - F.min("m")).alias("peak_to_peak"),
        F.skewness("m").alias("skew"),
        F.kurtosis("m").alias("kurt"),
        F.max("d1").alias("dfdt_max"),
        F.min("d1").alias("dfdt_min"),
        (F.max(F.when(F.col("k") == F.col("n") - 1, F.col("m"))) / F.min("m")).alias("frac_of_peak"),
        F.sum(F.when(turn, 1).otherwise(0)).alias("n_inflections"),
        F.count(F.lit(1)).alias("n"),
    )
    shaped = (F.col("n") > 3) & (F.col("sigma_f") > 1e-10)
    return g.withColumns({"skew": F.when(shaped, F.col("skew")), "kurt": F.when(shaped, F.col("kurt")), "n_inflections": F.when(F.col("n") > 2, F.col("n_inflections"))}).drop("n")


def interpolate(curve: DataFrame, wanted: DataFrame) -> DataFrame:
    """Value of each object's curve at the times (object, q) of ``wanted``: linear between points, constant outside.

    Points and questions are one table in one order of time; each question looks back to the last point and
    ahead to the next, so the rows are those that were given. Objects without points give no rows.
    """
    point = F.struct("t", "m").alias("point")
    asked = wanted.select("object", F.col("q").alias("t"), F.lit(1).alias("asks"), F.lit(None).cast("struct<t: double, m: double>").alias("point"))
    rows = curve.select("object", F.col("t").cast("double").alias("t"), F.col("m").cast("double").alias("m")).select("object", "t", F.lit(0).alias("asks"), point).union(asked)
    # A point at the time of a question comes before it.
    order = "OVER (PARTITION BY object ORDER BY t, asks"
    rows = rows.withColumns(
        {
            "a": F.expr(f"last_value(point) IGNORE NULLS {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
            "b": F.expr(f"lead(point, 1) IGNORE NULLS {order})"),
        }
    )
    inside = F.col("a.m") + (F.col("b.m") - F.col("a.m")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    value = F.when(F.col("a").isNull(), F.col("b.m")).when(F.col("b").isNull(), F.col("a.m")).otherwise(inside)
    return rows.where("asks = 1 and (a is not null or b is not null)").select("object", F.col("t").alias("q"), value.alias("value"))


def local_derivatives(curve: DataFrame, last: DataFrame) -> DataFrame:
    """Derivatives and forecasts around each object's last observation (object, t_last), a day apart."""
    wanted = last.withColumn("step", F.explode(F.array(*[F.lit(x) for x in (-1, 0, 1, 2, 3)]))).withColumn("q", F.col("t_last") + F.col("step"))
    v = interpolate(curve, wanted.select("object", "q")).join(last, "object").withColumn("step", F.round(F.col("q") - F.col("t_last")).cast("int"))
    at = {s: F.max(F.when(F.col("step") == s, F.col("value"))) for s in (-1, 0, 1, 2, 3)}
    return v.groupBy("object").agg(
        (at[0] - at[-1]).alias("dfdt_now"),
        (at[1] - at[0]).alias("dfdt_next"),
        (at[1] - 2 * at[0] + at[-1]).alias("d2fdt2_now"),
        at[1].alias("mag_1d"),
        at[2].alias("mag_2d"),
        (at[3] - at[2]).alias("extrap_slope"),
    )


def borrowed_offsets(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Median offset of sparse bands (1 to 4 points) from their object's reference curve (object, t, m)."""
    w = Window.partitionBy("object", "band")
    sparse = rows.withColumn("n_points", F.count(F.lit(1)).over(w)).where("n_points < 5")
    ref = interpolate(reference, sparse.select("object", F.col("mjd").alias("q")).distinct())
    joined = sparse.join(ref.withColumnRenamed("q", "mjd"), ["object", "mjd"]).select("object", "band", (F.col("mag") - F.col("value")).alias("d"))
    return joined.groupBy("object", "band").agg(F.median("d").alias("offset"), F.count(F.lit(1)).alias("n_points"))


def borrowed_curves(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """(object, band, t, m): the reference curve of its object, moved by its offset, for each sparse band."""
    offsets = borrowed_offsets(rows, reference).select("object", "band", "offset")
    return reference.join(offsets, "object").select("object", "band", "t", (F.col("m") + F.col("offset")).alias("m"))


def temperature(mean_mag: Column, sigma_mag: Column) -> tuple[Column, Column]:
    """Temperature of a mean magnitude and its error, each within its limits."""
    t = F.least(F.greatest(15000.0 * F.pow(F.lit(10.0), (18.0 - mean_mag) / 5), F.lit(3000.0)), F.lit(50000.0))
    return t, F.least(t * (math.log(10) / 5) * sigma_mag, t * 0.8)


def temperature_features(curve: DataFrame) -> DataFrame:
    """Peak, present and slopes of a temperature curve (object, t, m)."""
    w = Window.partitionBy("object").orderBy("k")
    c = indexed(curve).withColumns({"before": F.lag("m").over(w), "after": F.lead("m").over(w), "t_before": F.lag("t").over(w)})
    first = lambda x: F.max(F.when(F.col("k") == x, F.col("t")))
    top = F.max(F.struct("m", "k", "before", "after"))
    g = c.groupBy("object").agg(top.alias("p"), (first(1) - first(0)).alias("dt"), F.max(F.struct("k", "m", "before", (F.col("t") - F.col("t_before")).alias("step"))).alias("l"))
    return g.select("object", F.col("p.m").alias("t_peak"), F.col("l.m").alias("t_now"), ((F.col("p.after") - F.col("p.before")) / (2 * F.nullif("dt", F.lit(0.0)))).alias("slope_peak"), ((F.col("l.m") - F.col("l.before")) / F.nullif("l.step", F.lit(0.0))).alias("slope_now"))


def index_percentiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Elements floor(0.16 n), floor(n / 2) and floor(0.84 n) of each group's sorted values; nulls do not count.

    Rows are ranked and three of each group are picked; no group becomes one row.
    """
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy(F.col(value).asc_nulls_last())) - 1
    ranked = rows.select(*keys, F.col(value).alias("__x"), place.alias("__k"), F.count(value).over(w).alias("__n"))
    at = lambda p: F.max(F.when(F.col("__k") == F.floor(F.col("__n") * p), F.col("__x")))
    return ranked.groupBy(*keys).agg(at(0.16).alias("p16"), at(0.5).alias("p50"), at(0.84).alias("p84"))
