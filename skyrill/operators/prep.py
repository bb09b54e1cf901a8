"""Observation preparation: values, validity, duplicate epochs, bulk start, limits and sampling.

Rows are observations (object, band, mjd, flux, err) with a tie order ``pos``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ZP_NANO, finite, flux_to_mag, flux_to_mag_err, upper_median

#: Days before the upper median epoch from which observations count.
BULK_DAYS = 50.0
SNR_LIMIT = 3.0
MIN_POINTS = 5
SUBSAMPLE_OVER, SUBSAMPLE_TO = 30, 25
#: Rows that a task of ``prepare`` sorts, about.
TASK_ROWS = 1_000_000


def choose_value(rows: DataFrame, zero_point: float = ZP_NANO) -> DataFrame:
    """Magnitude of each row (mag, magerr, flux, err): given if usable, else from a positive flux; rows with neither go."""
    direct = (F.col("magerr") > 0) & finite(F.col("mag")).isNotNull()
    from_flux = (F.col("flux") > 0) & (F.col("err") > 0)
    value = F.when(direct, F.col("mag")).when(from_flux, flux_to_mag(F.col("flux"), zero_point))
    error = F.when(direct, F.col("magerr")).when(from_flux, flux_to_mag_err(F.col("flux"), F.col("err")))
    origin = F.when(direct, "mag").when(from_flux, "flux")
    return rows.withColumns({"value": value, "value_err": error, "origin": origin}).where("origin is not null")


def prepare(rows: DataFrame, to_mag: bool = True) -> DataFrame:
    """Deduplicated, trimmed observations (object, band, t, mjd, value, value_err).

    Time starts at the object's first row, valid or not. Of observations of one band
    within a millionth of a day the one of least error stays. Observations
    over ``BULK_DAYS`` before the object's upper median epoch go. Objects are dealt to so many
    tasks that none sorts much more than ``TASK_ROWS`` rows, but for those of one object.
    """
    parts = math.ceil(rows.count() / TASK_ROWS)
    few = parts <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition("object") if few else rows.repartition(parts, "object")
    valid = F.expr("err > 0" + (" and flux > 0" if to_mag else ""))
    key = F.greatest(F.lit(0), F.round(F.col("mjd") * 1e6)).cast("long")
    seen = F.when(valid, F.struct("err", "pos", "mjd", "flux"))
    best = dealt.groupBy("object", "band", key.alias("key")).agg(F.min(seen).alias("b"), F.min("mjd").alias("first"))
    # Epochs without a valid row only tell the start, and come last in the ranks.
    epochs = best.select("object", "band", F.col("b").isNull().alias("none"), "b.err", "b.mjd", "b.flux", "first")
    per_object = Window.partitionBy("object")
    # The upper median is the epoch of rank n div 2 from 0: ranks, not arrays, so an object's rows may spill.
    ranked = epochs.withColumn("k", F.row_number().over(per_object.orderBy("none", "mjd")) - 1)
    ranked = ranked.withColumns({"n": F.count(F.when(~F.col("none"), 1)).over(per_object), "start": F.min("first").over(per_object)})
    middled = ranked.withColumn("middle", F.max(F.when(F.col("k") == F.floor(F.col("n") / 2), F.col("mjd"))).over(per_object))
    kept = middled.where(~F.col("none") & (F.col("mjd") >= F.col("middle") - BULK_DAYS))
    value, error = (flux_to_mag(F.col("flux")), flux_to_mag_err(F.col("flux"), F.col("err"))) if to_mag else (F.col("flux"), F.col("err"))
    return kept.select("object", "band", (F.col("mjd") - F.col("start")).alias("t"), "mjd", value.alias("value"), error.alias("value_err"))


def normalize(rows: DataFrame, snr: float = SNR_LIMIT) -> DataFrame:
    """Flux and error over the band's peak, and upper limits: points below ``snr`` with their ceiling. Bands whose peak is not positive go."""
    w = Window.partitionBy("object", "band")
    n = rows.withColumn("peak", F.max("flux").over(w)).where("peak > 0")
    upper = (F.col("err") > 0) & (F.col("flux") / F.col("err") < snr)
    return n.withColumns({"y": F.col("flux") / F.col("peak"), "s": F.col("err") / F.col("peak"), "is_upper": upper, "ceiling": F.lit(snr) * F.col("err") / F.col("peak")})


def reference_band(rows: DataFrame) -> DataFrame:
    """Bands of ``MIN_POINTS`` points or more by falling size; rank 1 is the object's reference."""
    sizes = rows.groupBy("object", "band").agg(F.count(F.lit(1)).alias("n_points")).where(F.col("n_points") >= MIN_POINTS)
    order = Window.partitionBy("object").orderBy(F.desc("n_points"), "band")
    return sizes.withColumn("rank", F.row_number().over(order).cast("long"))


def subsample(rows: DataFrame, over: int = SUBSAMPLE_OVER, to: int = SUBSAMPLE_TO) -> DataFrame:
    """All points of groups of at most ``over``, else ``to`` of them spread evenly by rank."""
    w = Window.partitionBy("object", "band")
    ranked = rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("k", F.row_number().over(w.orderBy("mjd", "pos")) - 1)
    # Rank k is chosen when some i has floor((i + 0.5) * n / to) = k; that i is ceil(to * k / n - 0.5).
    i = F.ceil(F.lit(float(to)) * F.col("k") / F.col("n") - 0.5)
    chosen = (i >= 0) & (i < to) & (F.floor((i + 0.5) * F.col("n") / float(to)) == F.col("k"))
    return ranked.where((F.col("n") <= over) | chosen)


def min_lengthscale(rows: DataFrame) -> DataFrame:
    """Twice the upper median of the steps between observations of a band, 0.1 at least."""
    w = Window.partitionBy("object", "band").orderBy("mjd", "pos")
    steps = rows.withColumn("step", F.col("mjd") - F.lag("mjd").over(w)).where("step is not null")
    g = steps.groupBy("object", "band").agg(upper_median(F.collect_list("step")).alias("step"), F.count(F.lit(1)).alias("n_steps"))
    return g.select("object", "band", F.greatest(2 * F.col("step"), F.lit(0.1)).alias("min_lengthscale"), "n_steps")


def noise_fraction(rows: DataFrame) -> DataFrame:
    """Median of error over flux of each band's positive fluxes."""
    ratio = F.when(F.col("flux") > 0, F.col("err") / F.col("flux"))
    return rows.groupBy("object", "band").agg(F.median(ratio).alias("noise_fraction"))


def display_error(rows: DataFrame, default: float = 0.1) -> DataFrame:
    """Magnitude error of each flux; ``default`` where the flux is not positive."""
    return rows.withColumn("mag_err", F.coalesce(flux_to_mag_err(F.col("flux"), F.col("err")), F.lit(default)))
