"""Validation: method against method, classes against models, and simulated curves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import MODELS, flux_numpy
from .quantile import quantile_by

#: Which models are natural for each simulated class.
NATURAL = {
    "kilonova": ["MetzgerKN", "Bazin"],
    "supernova": ["Bazin", "Villar", "Arnett"],
    "tde": ["Tde"],
    "bazin_phenom": ["Bazin"],
    "afterglow": ["Afterglow"],
}
#: Duration and cadence in days of each simulated class, with the model that draws it.
SIMULATED = {"kilonova": (15.0, 1.5, "MetzgerKN"), "supernova": (120.0, 3.0, "Arnett"), "tde": (300.0, 4.0, "Tde"), "bazin_phenom": (150.0, 3.0, "Bazin"), "afterglow": (120.0, 3.0, "Afterglow")}
# Bands and their shares, share of lost nights, exposures a night, drift of a night in days, sky noise by band and share of calibration noise.
BANDS, BAND_SHARE, GAP, PER_NIGHT, JITTER = ("g", "r", "i"), (0.35, 0.45, 0.20), 0.3, (0.4, 0.4, 0.2), 0.5
FLOOR, CALIBRATION = {"g": 3.0, "r": 3.5, "i": 5.0}, 0.05


def compare_methods(a: DataFrame, b: DataFrame, value: str, least: int = 3) -> DataFrame:
    """Correlation, median difference and count of pairs of ``value`` on (object, band), by band."""
    x = a.select("object", "band", F.col(value).alias("x"))
    y = b.select("object", "band", F.col(value).alias("y"))
    pairs = x.join(y, ["object", "band"]).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    pairs = pairs.withColumn("d", F.col("y") - F.col("x"))
    stats = pairs.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, F.corr("x", "y")).alias("r"))
    return _with_medians(stats, pairs, "band", {"median_difference": "d"})


def _with_medians(stats: DataFrame, rows: DataFrame, key: str, medians: dict[str, str]) -> DataFrame:
    """``stats`` by ``key`` (nulls alike) with the exact median of each column of ``rows``."""
    for out, column in medians.items():
        m = quantile_by(rows, [key], column, out).withColumnRenamed(key, "__key")
        stats = stats.join(m, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    return stats


def histogram(rows: DataFrame, x: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts of ``x`` in equal bins, the last one closed; values outside are left out."""
    inside = rows.select(x.alias("x")).where(F.col("x").between(lo, hi))
    bin_ = F.least(F.floor((F.col("x") - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("long")
    return inside.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_auto(rows: DataFrame, x: Column, bins: int = 25) -> DataFrame:
    """(bin, low, high, n) of ``bins`` equal bins from the least to the largest value, empty ones included; missing values do not count.

    With equal values only, the bins span half a unit to either side of it; a table without values has no bins.
    """
    values = rows.select(x.cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    lo, hi = values.agg(F.min("x"), F.max("x")).first()
    if lo is None:
        return histogram(values, F.col("x"), 0.0, 1.0, 1).select("bin", F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), "n")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    every = rows.sparkSession.range(bins).select(F.col("id").alias("bin"), (F.lit(lo) + F.col("id") * width).alias("low"), (F.lit(lo) + (F.col("id") + 1) * width).alias("high"))
    return every.join(histogram(values, F.col("x"), lo, hi, bins), "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def class_validation(rows: DataFrame) -> DataFrame:
    """Count, median, mean and shares below 1 and 5 of chi2 by class, with a total (class null)."""
    both = rows.select("class", "chi2").union(rows.select(F.lit(None).cast("string"), "chi2"))
    stats = both.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("chi2").alias("mean_chi2"),
        (100 * F.avg((F.col("chi2") < 1).cast("double"))).alias("below_1"),
        (100 * F.avg((F.col("chi2") < 5).cast("double"))).alias("below_5"),
    )
    return _with_medians(stats, both, "class", {"median_chi2": "chi2"})


def model_histogram(fits: DataFrame) -> DataFrame:
    """Bands by class and selected model."""
    return fits.groupBy("class", "model").agg(F.count(F.lit(1)).alias("n"))


def with_truth(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Results (object, band, param, value) beside the true value of the parameter; objects without a truth row go, a parameter that the truth lacks is null."""
    t = truth.select("object", "class", F.col("params").alias("__params"))
    joined = results.join(t, "object").withColumn("true_value", F.try_element_at("__params", F.col("param")))
    return joined.withColumn("error", F.col("value") - F.col("true_value")).drop("__params")


def object_model(fits: DataFrame) -> DataFrame:
    """Model of each object: that of its band of least finite chi2 (first band of equals), else its most common model (first name of equals)."""
    ok = F.col("chi2").isNotNull() & ~F.isnan("chi2") & (F.abs("chi2") != float("inf"))
    per_model = fits.groupBy("object", "class", "model").agg(F.min(F.when(ok, F.struct("chi2", "band", "model"))).alias("b"), F.count(F.lit(1)).alias("n"))
    both = per_model.groupBy("object", "class").agg(F.min("b").alias("b"), F.min(F.struct((-F.col("n")).alias("c"), "model")).alias("m"))
    return both.select("object", "class", F.coalesce("b.model", "m.model").alias("model"))


def confusion(models: DataFrame, names: list[str]) -> DataFrame:
    """Objects by class (rows) and model (columns)."""
    return models.groupBy("class").pivot("model", names).agg(F.count(F.lit(1))).na.fill(0, names)


def accuracy(models: DataFrame, natural: dict[str, list[str]]) -> DataFrame:
    """Share of objects with a natural model of their class, by class and in total (class null)."""
    table = F.create_map(*[x for c, m in natural.items() for x in (F.lit(c), F.array(*map(F.lit, m)))])
    right = F.coalesce(F.array_contains(table[F.col("class")], F.col("model")), F.lit(False))
    return models.withColumn("right", right.cast("double")).rollup("class").agg(F.count(F.lit(1)).alias("n"), F.avg("right").alias("accuracy"))


def compare_parameters(params: DataFrame) -> DataFrame:
    """Swarm value against posterior mean of each parameter: count, correlation and median difference over finite triples."""
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in ("pso_value", "svi_mean", "svi_std")]
    rows = params.where(ok[0] & ok[1] & ok[2]).withColumn("d", F.col("svi_mean") - F.col("pso_value"))
    stats = rows.groupBy("param").agg(F.count(F.lit(1)).alias("n"), F.corr("pso_value", "svi_mean").alias("r"))
    return _with_medians(stats, rows, "param", {"median_difference": "d", "median_std": "svi_std"})


def throughput(results: DataFrame, wall_seconds: float) -> DataFrame:
    """Objects and bands a second from results (object, band, fit_seconds)."""
    n, m = F.count_distinct("object"), F.count(F.lit(1))
    return results.agg(n.alias("objects"), m.alias("bands"), (n / wall_seconds).alias("objects_per_s"), (m / wall_seconds).alias("bands_per_s"), F.avg("fit_seconds").alias("mean_fit_s"))


def _draw(kind: str, rng: np.random.Generator) -> np.ndarray:
    """True parameters of one simulated object: the start values of its class's model, spread, with its onset inside the curve."""
    model = MODELS[SIMULATED[kind][2]]
    theta = np.array(model.start) + rng.normal(0, 0.1, len(model.start))
    theta[model.t0] = SIMULATED[kind][0] * 0.2 if model.flux else 0.5
    return theta


def _cadence(duration: float, cadence: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Times and bands: nights that drift by a jitter each, some lost, with up to three exposures within half an hour."""
    steps = cadence + rng.normal(0, JITTER, int(3 * duration / cadence) + 10)
    nights = rng.uniform(0.1, 1.0) + np.concatenate([[0.0], np.cumsum(steps)])
    nights = nights[: np.argmax(nights >= duration)] if (nights >= duration).any() else nights
    nights = nights[rng.random(len(nights)) > GAP]
    t = np.repeat(nights, rng.choice([1, 2, 3], len(nights), p=PER_NIGHT))
    return t + rng.uniform(0, 0.02, len(t)), rng.choice(BANDS, len(t), p=BAND_SHARE)


def _simulate(i: int, per_class: int) -> tuple[str, str, np.ndarray, pd.DataFrame]:
    """Name, class, true parameters and curve of object i."""
    kind = list(SIMULATED)[i // per_class]
    rng = np.random.Generator(np.random.PCG64(1000 + i))
    duration, cadence, model = SIMULATED[kind]
    theta = _draw(kind, rng)
    t, band = _cadence(duration, cadence, rng)
    flux = 200.0 * flux_numpy(MODELS[model], theta[None], t)[0]
    sky = np.array([FLOOR[b] for b in band]) * rng.uniform(0.8, 1.5, len(t))
    err = np.hypot(CALIBRATION * flux, sky)
    seen = flux + rng.normal(0, 1, len(t)) * err
    name = f"sim_{kind}_{i % per_class:03d}"
    out = pd.DataFrame({"object": name, "class": kind, "band": band, "mjd": 60700.0 + t, "flux": seen, "err": err})
    out = out[np.isfinite(out["flux"]) & (out["flux"] > 0)].sort_values(["mjd", "band"])
    return name, kind, theta, out if len(out) >= 5 else out.iloc[:0]


def simulate(spark, per_class: int = 50) -> DataFrame:
    """Noisy curves of every simulated class; each object draws from its own seed, so the rows do not depend on partitions."""

    def run(batches):
        for b in batches:
            for i in b["id"]:
                yield _simulate(int(i), per_class)[3]

    return spark.range(per_class * len(SIMULATED)).mapInPandas(run, "object string, class string, band string, mjd double, flux double, err double")


def simulated_truth(spark, per_class: int = 50) -> DataFrame:
    """(object, class, model, params, n_obs) of the objects that ``simulate`` draws; those whose curve is too short are left out."""

    def run(batches):
        for b in batches:
            rows = [_simulate(int(i), per_class) for i in b["id"]]
            models = [MODELS[SIMULATED[kind][2]] for _, kind, _, _ in rows]
            params = [dict(zip(m.params[:-1], theta.tolist())) for m, (_, _, theta, _) in zip(models, rows)]
            out = pd.DataFrame({"object": [r[0] for r in rows], "class": [r[1] for r in rows], "model": [m.name for m in models], "params": params, "n_obs": [len(r[3]) for r in rows]})
            yield out[out["n_obs"] > 0]

    return spark.range(per_class * len(SIMULATED)).mapInPandas(run, "object string, class string, model string, params map<string,double>, n_obs long")
