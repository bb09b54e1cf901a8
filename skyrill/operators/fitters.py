"""Fits over DataFrames: whole bands, many of them stacked in a task."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kilonova import with_kilonova, with_kilonovas
from ..functions.models import MODELS, flux_numpy
from . import gp, search
from .features import grid
from .prep import MIN_POINTS

PARAM_SCHEMA = "object string, band string, model string, param string, pso_value double, svi_mean double, svi_std double, pso_chi2 double, svi_elbo double, mag_chi2 double"
#: Bands that are fitted together; small stacks spend their time on calls, large ones hold more memory (some 400 MB at this size).
STACKED = 512
#: Bands that a task of parametric fits holds: those of one model share the steps of their posteriors, and a model of few bands costs as many calls as one of many.
FITTED = 4096
#: Rows of such a task, about, where there are more than the tasks that run at once would hold.
FIT_ROWS = 100_000
CURVE_SCHEMA = "object string, band string, t double, p16 double, p50 double, p84 double"


def seed_of(*parts) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode())


def _band(frame: pd.DataFrame) -> search.Band:
    return search.Band(*(frame[c].to_numpy(float) for c in ("t", "y", "s")), frame["is_upper"].to_numpy(bool), frame["ceiling"].to_numpy(float))


def _mag_chi2(model, mu: np.ndarray, band: search.Band) -> float:
    pred = flux_numpy(model, mu[None], band.t)[0]
    use = (pred > 0) & (band.y > 0)
    if not use.any():
        return float("nan")
    r = 2.5 * np.log10(pred[use] / band.y[use]) / (1.0857 * band.s[use] / band.y[use])
    return float((r * r).mean())


def fit_parametric(rows: DataFrame, steps: int = 1000, samples: int = 4, rate: float = 0.01, retry: bool = False, only: str | None = None, onset_search: bool = False) -> DataFrame:
    """Parameter table of every object and band of ``MIN_POINTS`` points or more.

    Rows are normalised observations (object, band, t, y, s, is_upper, ceiling).
    """

    def one(o: str, b: str, band: search.Band, f: dict) -> dict:
        model = MODELS[f["model"]]
        _, width, mu = search.refine_onset(model, f["mu"], band)
        sigma = f["sigma"].copy()
        sigma[model.t0] = width
        same = {"object": o, "band": b, "model": model.name, "pso_chi2": f["cost"], "svi_elbo": f["elbo"], "mag_chi2": _mag_chi2(model, mu, band)}
        return {k: [x] * len(mu) for k, x in same.items()} | {"param": model.params, "pso_value": f["theta"], "svi_mean": mu, "svi_std": sigma}

    columns = [c.split()[0] for c in PARAM_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frames in _some_bands(batches, FITTED):
            names = [(f["object"].iloc[0], f["band"].iloc[0]) for f in frames]
            bands = [_band(f) for f in frames]
            fits = search.fit_bands(bands, [seed_of(*n, "fit") for n in names], steps, samples, rate, retry, only, onset_search)
            made = [one(*names[k], bands[k], f) for k, f in fits]
            yield pd.DataFrame({c: [x for m in made for x in m[c]] for c in columns})

    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / FIT_ROWS))
    big = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("object", "band"))).where(F.col("__n") >= MIN_POINTS).drop("__n")
    big = big.select(F.col("object").cast("string").alias("object"), "band", "t", "y", "s", "is_upper", "ceiling")
    # So many tasks, or the join of small parts would leave some cores without any or one with two.
    return big.repartition(tasks, "object", "band").sortWithinPartitions("object", "band", "t", "y").mapInPandas(run, PARAM_SCHEMA)


def _some_bands(batches: Iterator[pd.DataFrame], most: int = STACKED) -> Iterator[list[pd.DataFrame]]:
    """Whole bands of rows sorted by object and band, at most ``most`` at a time; a task holds these only."""
    held: list[pd.DataFrame] = []
    for rows in batches:
        parts = [f for _, f in rows.groupby(["object", "band"], sort=False, dropna=False)]
        if held and parts and all(held[-1][k].iloc[0] == parts[0][k].iloc[0] for k in ("object", "band")):
            parts[0] = pd.concat([held.pop(), parts[0]], ignore_index=True)
        held += parts
        while len(held) > most:
            yield held[:most]
            held = held[most:]
    if held:
        yield held


def posterior_curves(params: DataFrame, spans: DataFrame, zero_point: float = 23.9, draws: int = 200, points: int = 50) -> DataFrame:
    """Percentile magnitudes over a grid, from a parameter table and (object, band, t_min, t_max, peak)."""

    def one(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        model = MODELS[frame["model"].iloc[0]]
        p = frame.set_index("param").loc[list(model.params)]
        lo, hi = frame["t_min"].iloc[0], frame["t_max"].iloc[0]
        t = np.linspace(lo, lo + max(hi - lo, 1.0), points)
        rng = np.random.Generator(np.random.PCG64(seed_of(frame["object"].iloc[0], frame["band"].iloc[0], "posterior")))
        return t, search.posterior_bands(model, p["svi_mean"].to_numpy(), p["svi_std"].to_numpy(), t, frame["peak"].iloc[0], zero_point, rng, draws)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frames in _some_bands(batches):
            curves = [one(f) for f in frames]
            names = {k: np.repeat([f[k].iloc[0] for f in frames], points) for k in ("object", "band")}
            q = np.concatenate([x for _, x in curves], axis=1)
            yield pd.DataFrame(names | {"t": np.concatenate([t for t, _ in curves]), "p16": q[0], "p50": q[1], "p84": q[2]})

    spans = spans.select(F.col("object").cast("string").alias("object"), "band", "t_min", "t_max", "peak")
    met = params.join(spans, ["object", "band"])
    return met.repartition("object", "band").sortWithinPartitions("object", "band").mapInPandas(run, CURVE_SCHEMA)


def fit_gp(rows: DataFrame, backend: str = "B") -> DataFrame:
    """Feature rows of every object and band of ``MIN_POINTS`` points or more.

    Rows are observations in magnitudes (object, band, t, value, value_err). The
    object's time span comes from a window, so bands are fitted apart; a table of some bands' features
    is made at once, as one for each band costs many times the fit.
    """
    extra = ("gp_amp", "gp_lengthscale", "gp_alpha") if backend == "B" else ("gp_theta_init", "gp_nugget")
    columns = [*gp.FEATURES, *extra]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frames in _some_bands(batches):
            fits = [(f["object"].iloc[0], f["band"].iloc[0], gp.fit_band(*(f[c].to_numpy(float) for c in ("t", "value", "value_err")), (f["t_lo"].iloc[0], f["t_hi"].iloc[0]), backend)) for f in frames]
            solved = [(o, b, row) for o, b, row in fits if row]
            out = pd.DataFrame([row for *_, row in solved], columns=columns).astype(float)
            out.insert(0, "object", [o for o, *_ in solved])
            out.insert(1, "band", [b for _, b, _ in solved])
            yield out

    w = Window.partitionBy("object")
    spread = rows.withColumns({"t_lo": F.min("t").over(w), "t_hi": F.max("t").over(w), "__n": F.count(F.lit(1)).over(Window.partitionBy("object", "band"))})
    ready = spread.where(F.col("__n") >= MIN_POINTS).select(F.col("object").cast("string").alias("object"), "band", "t", "value", "value_err", "t_lo", "t_hi")
    return ready.repartition("object", "band").sortWithinPartitions("object", "band", "t", "value").mapInPandas(run, "object string, band string, " + ", ".join(f"{c} double" for c in columns))


def kilonova_curves(spans: DataFrame, theta: tuple[float, ...], points: int = 50) -> DataFrame:
    """The one-zone model on a grid over each row's (object, t_min, t_max)."""
    rows = grid(spans, points).select("object", "t")
    return with_kilonova(rows, ["object"], theta, "flux").select(F.col("object").cast("string").alias("object"), "t", "flux")


def kilonova_gradients(spans: DataFrame, theta: tuple[float, ...], points: int = 50, step: float = 1e-5) -> DataFrame:
    """``kilonova_curves`` with the forward difference of the flux by each parameter."""
    rows = grid(spans, points).select("object", "t")
    names = MODELS["MetzgerKN"].params[: len(theta)]
    moved = {f"d_{name}": tuple(x + step * (i == k) for i, x in enumerate(theta)) for k, name in enumerate(names)}
    rows = with_kilonovas(rows, ["object"], {"flux": theta, **moved})
    return rows.select(F.col("object").cast("string").alias("object"), "t", "flux", *[((F.col(f"d_{n}") - F.col("flux")) / step).alias(f"d_{n}") for n in names])
