"""Alert enrichment: merged curves, per-band and all-band extremes, rise and fade rates.

Input rows are points (object, band, mjd, mag, mag_err, pos); ``pos`` orders
points of one time. Everything is a mergeable aggregate or one window on the
grouping key, so an object costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = ["g", "r", "i", "z", "y", "u"]
#: Days that a segment or a curve must span.
MIN_SPAN = 0.01


def merge_curves(first: DataFrame, second: DataFrame) -> DataFrame:
    """Points of ``first`` followed by those of ``second``, in time order without repeats.

    A point goes when its predecessor in (time, origin, pos) order has its time and band.
    """
    both = first.withColumn("origin", F.lit(0)).unionByName(second.withColumn("origin", F.lit(1)))
    order = Window.partitionBy("object").orderBy("mjd", "origin", "pos")
    same = (F.lag("mjd").over(order) == F.col("mjd")) & (F.lag("band").over(order) == F.col("band"))
    return both.withColumn("same", F.coalesce(same, F.lit(False))).where("not same").drop("same")


def band_extremes(points: DataFrame) -> DataFrame:
    """Brightest (smallest magnitude) and faintest point of each object and band; the earliest of equals."""
    peak = F.min(F.struct("mag", "mjd", "pos", "mag_err"))
    faint = F.max(F.struct("mag", (-F.col("mjd")).alias("t"), (-F.col("pos")).alias("p"), "mag_err"))
    g = points.groupBy("object", "band").agg(peak.alias("p"), faint.alias("f"), F.count(F.lit(1)).alias("n_points"))
    return g.select(
        "object",
        "band",
        F.col("p.mjd").alias("peak_mjd"),
        F.col("p.mag").alias("peak_mag"),
        F.col("p.mag_err").alias("peak_mag_err"),
        (-F.col("f.t")).alias("faint_mjd"),
        F.col("f.mag").alias("faint_mag"),
        F.col("f.mag_err").alias("faint_mag_err"),
        "n_points",
    )


def all_bands(points: DataFrame) -> DataFrame:
    """Extremes over all bands, first and last time, and whether the object stays (stationary)."""
    peak = F.min(F.struct("mag", "mjd", "pos", "mag_err", "band"))
    faint = F.max(F.struct("mag", (-F.col("mjd")).alias("t"), (-F.col("pos")).alias("p"), "mag_err", "band"))
    g = points.groupBy("object").agg(peak.alias("p"), faint.alias("f"), F.min("mjd").alias("first_mjd"), F.max("mjd").alias("last_mjd"))
    return g.select(
        "object",
        F.col("p.mjd").alias("peak_mjd"),
        F.col("p.mag").alias("peak_mag"),
        F.col("p.mag_err").alias("peak_mag_err"),
        F.col("p.band").alias("peak_band"),
        (-F.col("f.t")).alias("faint_mjd"),
        F.col("f.mag").alias("faint_mag"),
        F.col("f.mag_err").alias("faint_mag_err"),
        F.col("f.band").alias("faint_band"),
        "first_mjd",
        "last_mjd",
        (F.col("last_mjd") - F.col("first_mjd") > MIN_SPAN).alias("stationary"),
    )


def _segment(inside: Column, name: str) -> list[Column]:
    """Aggregates of a straight-line fit over the rows of one segment, with what its gates need."""
    pick = lambda x: F.when(inside, x)
    low = F.min(pick(F.struct("mag", "mjd", "pos", "mag_err")))
    high = F.max(pick(F.struct("mag", (-F.col("mjd")).alias("t"), (-F.col("pos")).alias("p"), "mag_err")))
    x = F.col("mjd") - F.col("peak.mjd")
    return [
        F.count(pick(F.lit(1))).alias(f"{name}_n"),
        (F.max(pick(F.col("mjd"))) - F.min(pick(F.col("mjd")))).alias(f"{name}_span"),
        low.alias(f"{name}_low"),
        high.alias(f"{name}_high"),
        F.regr_slope(pick(F.col("mag")), pick(x)).alias(f"{name}_slope"),
        F.regr_r2(pick(F.col("mag")), pick(x)).alias(f"{name}_r2"),
    ]


def band_rates(points: DataFrame) -> DataFrame:
    """Slopes before and after each band's peak; the peak belongs to both segments.

    A segment is fitted if it has two points or more, spans over ``MIN_SPAN`` days and
    its extremes differ by more than their errors.
    """
    w = Window.partitionBy("object", "band")
    rows = points.withColumn("peak", F.min(F.struct("mag", "mjd", "pos")).over(w))
    here, top = F.struct("mjd", "pos"), F.struct("peak.mjd", "peak.pos")
    g = rows.groupBy("object", "band").agg(F.first("peak").alias("peak"), *_segment(here <= top, "rise"), *_segment(here >= top, "fade"))
    out = [F.col("object"), F.col("band"), F.col("peak.mjd").alias("peak_mjd"), F.col("peak.mag").alias("peak_mag")]
    for s in ("rise", "fade"):
        noisy = F.col(f"{s}_low.mag") + F.col(f"{s}_low.mag_err") >= F.col(f"{s}_high.mag") - F.col(f"{s}_high.mag_err")
        fitted = (F.col(f"{s}_n") > 1) & (F.col(f"{s}_span") > MIN_SPAN) & ~noisy
        out += [F.when(fitted, F.col(f"{s}_{x}")).alias(f"{s}_{y}") for x, y in (("slope", "rate"), ("r2", "r2"), ("n", "n"))]
    return g.select(*out)


def pivot_bands(extremes: DataFrame) -> DataFrame:
    """One row for each object with the peak of each of the six bands."""
    return extremes.groupBy("object").pivot("band", BANDS).agg(F.first("peak_mag").alias("peak_mag"), F.first("peak_mjd").alias("peak_mjd"))


def with_current(candidate: Column, history: Column) -> Column:
    """The current detection in front of its history (arrays of points)."""
    return F.when(history.isNull(), F.array(candidate)).otherwise(F.concat(F.array(candidate), history))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def clean_curve(curve: Column) -> Column:
    """Points (time, k, mag, mag_err, band) of an array in time order, k their place; repeats of time and band and points without time, magnitude or band go."""
    given = F.filter(curve, lambda p: p["time"].isNotNull() & p["mag"].isNotNull() & p["band"].isNotNull())
    ordered = F.array_sort(F.transform(given, lambda p, i: F.struct(p["time"].alias("time"), i.alias("i"), p["mag"].cast("double").alias("mag"), p["mag_err"].cast("double").alias("mag_err"), p["band"].alias("band"))))
    fresh = _let(ordered, lambda a: F.filter(a, lambda p, i: (i == 0) | (F.get(a, i - 1)["time"] != p["time"]) | (F.get(a, i - 1)["band"] != p["band"])))
    return F.transform(fresh, lambda p, i: F.struct(p["time"].alias("time"), i.alias("k"), p["mag"].alias("mag"), p["mag_err"].alias("mag_err"), p["band"].alias("band")))


def _line(points: Column) -> Column:
    """(rate, r2, n) of a straight line through the points of a segment, null where its gates are not met (see ``band_rates``)."""
    zero = F.struct(*[F.lit(0.0).alias(x) for x in ("x", "y", "xx", "xy", "yy")])

    def fit(a: Column) -> Column:
        low = F.array_min(F.transform(a, lambda p: F.struct(p["mag"].alias("mag"), p["k"].alias("k"), p["mag_err"].alias("e"))))
        high = F.array_max(F.transform(a, lambda p: F.struct(p["mag"].alias("mag"), (-p["k"]).alias("k"), p["mag_err"].alias("e"))))
        n, first = F.size(a).cast("double"), F.get(a, F.lit(0))

        def add(s: Column, p: Column) -> Column:
            x, y = p["time"] - first["time"], p["mag"] - first["mag"]
            return F.struct((s["x"] + x).alias("x"), (s["y"] + y).alias("y"), (s["xx"] + x * x).alias("xx"), (s["xy"] + x * y).alias("xy"), (s["yy"] + y * y).alias("yy"))

        def solve(s: Column) -> Column:
            xx, xy, yy = n * s["xx"] - s["x"] * s["x"], n * s["xy"] - s["x"] * s["y"], n * s["yy"] - s["y"] * s["y"]
            return F.struct((xy / xx).alias("rate"), F.when(yy == 0, F.lit(1.0)).otherwise(xy * xy / (xx * yy)).alias("r2"), F.size(a).cast("long").alias("n"))

        wide = (F.size(a) > 1) & (F.get(a, F.size(a) - 1)["time"] - first["time"] > MIN_SPAN)
        return F.when(wide & ~(low["mag"] + low["e"] >= high["mag"] - high["e"]), _let(F.aggregate(a, zero, add), solve))

    return _let(points, fit)


def curve_bands(curve: Column) -> Column:
    """Map from band to its extremes and its rise and fade lines, from a clean curve held in one row.

    The row-wise twin of ``band_extremes`` and ``band_rates``, for alerts that carry their history.
    """

    def point(p: Column) -> Column:
        return F.struct(p["time"].alias("time"), p["mag"].alias("mag"), p["mag_err"].alias("mag_err"))

    def summary(a: Column) -> Column:
        at = F.array_min(F.transform(a, lambda p, i: F.struct(p["mag"].alias("mag"), i.alias("i"))))["i"]
        low = F.array_max(F.transform(a, lambda p, i: F.struct(p["mag"].alias("mag"), (-i).alias("i"))))["i"]
        rise, fade = F.slice(a, F.lit(1), at + 1), F.slice(a, at + 1, F.size(a) - at)
        return F.struct(point(F.get(a, at)).alias("peak"), point(F.get(a, -low)).alias("faint"), F.size(a).cast("long").alias("n_points"), _line(rise).alias("rise"), _line(fade).alias("fade"))

    bands = F.array_sort(F.array_distinct(F.transform(curve, lambda p: p["band"])))
    return F.map_from_entries(F.transform(bands, lambda b: F.struct(b.alias("band"), _let(F.filter(curve, lambda p: p["band"] == b), summary).alias("of"))))
