"""Stochastic fits of many bands at once in numpy: swarm search, model cascade, onset search and variational posterior.

Bands are stacked: arrays have a leading axis of points, then bands, then particles or samples, so one band's
parameters run along the points. Shorter bands are padded; sums go along the points, so padding adds zeros at their end. Every draw comes from a
generator seeded by the band and the model, so equal inputs give equal fits
whatever the partitioning and whichever bands are stacked together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..functions.likelihood import VAR_FLOOR, log_normal_cdf_numpy
from ..functions.kilonova import swift_kilonova
from ..functions.models import MODELS, Dual, DualOps, Model, NumpyOps, flux_numpy, gradient_numpy

PARTICLES, ITERATIONS, ONSET_ITERATIONS = 40, 50, 60
GOOD_ENOUGH = -3.0
#: Published constriction constants of particle swarms.
INERTIA, PULL = 0.7298, 1.49618
#: The posterior's spread is widened by this factor at the end (calibrated coverage).
INFLATION = 4.0
RETRY_BELOW = -1000.0
#: Bands that are stacked in a swarm, in one of the integrated model and in a posterior: as many as leave the arrays of a step in a core's cache.
SWARM_BANDS, CURVE_BANDS, POSTERIOR_BANDS = 64, 256, 256


@dataclass
class Band:
    """Observations of one band: flux and error over the peak, limits and their ceilings."""

    t: np.ndarray
    y: np.ndarray
    s: np.ndarray
    upper: np.ndarray
    ceiling: np.ndarray


class Stack:
    """Bands as (points, bands) arrays, ``real`` marks points that are not padding, and a seed for each band."""

    def __init__(self, bands: list[Band], seeds: list[int]):
        width = max(map(padded, bands))

        def stack(name: str) -> np.ndarray:
            # Padding repeats the first point, so no model sees a time that is not the band's.
            return np.stack([np.concatenate([x, np.full(width - len(x), x[0])]) for x in (getattr(b, name) for b in bands)], 1)

        self.t, self.y, self.s, self.upper, self.ceiling = map(stack, ("t", "y", "s", "upper", "ceiling"))
        self.real = np.arange(width)[:, None] < np.array([len(b.t) for b in bands])
        self.seeds = np.array(seeds, np.uint64)

    def __len__(self) -> int:
        return len(self.seeds)

    def take(self, which: np.ndarray) -> Stack:
        out = object.__new__(Stack)
        for name, x in vars(self).items():
            setattr(out, name, x[..., which])
        return out

    def limits(self) -> np.ndarray:
        """(2, n): points and bands of the upper limits, the only places where their likelihood is needed."""
        return np.array(np.nonzero(self.upper & self.real))

    def draws(self, purpose: str, kind: str, shape: tuple[int, ...]) -> np.ndarray:
        """Draws of a ``kind`` from each band's own generator for a purpose, bands first."""
        salt = int.from_bytes(purpose.encode(), "little") % (1 << 61)
        out = np.empty((len(self), *shape))
        for x, seed in zip(out, self.seeds):
            getattr(np.random.Generator(np.random.PCG64([int(seed), salt])), kind)(out=x)
        return out


def padded(band: Band) -> int:
    """Lengths that are stacked are alike: multiples of 16, then powers of two."""
    n = len(band.t)
    return 16 * math.ceil(n / 16) if n <= 64 else 1 << (n - 1).bit_length()


def flux(model: Model, theta: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(points, bands, rows) fluxes of (bands, rows, parameters) at (points, bands) times."""
    if model.flux is None:
        return swift_kilonova(theta, t)
    with np.errstate(all="ignore"):
        return model.evaluate(NumpyOps, np.moveaxis(theta, 2, 0), t[:, :, None]) + np.zeros((*t.shape, theta.shape[1]))


def flux_gradient(model: Model, theta: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, list]:
    """``flux`` and its derivatives, one for each parameter, which meet the shape of the fluxes."""
    n, rows, k = theta.shape
    if model.flux is None:
        f, g = gradient_numpy(model, theta.reshape(n * rows, k), np.repeat(t.T, rows, axis=0))
        return f.T.reshape(-1, n, rows), list(np.moveaxis(g, (2, 1), (0, 1)).reshape(k, -1, n, rows))
    p = {name: Dual(x, {name: 1.0}) for name, x in zip(model.params, np.moveaxis(theta, 2, 0))}
    with np.errstate(all="ignore"):
        f = model.flux(DualOps(NumpyOps), p, Dual.of(t[:, :, None]))
    return f.v, [f.d.get(name, 0.0) for name in model.params]


def rescale(pred: np.ndarray, x: Stack) -> tuple[np.ndarray, np.ndarray]:
    """For each band and row the factor that scales the integrated model to a peak of one at detections, within 0.1 and 10; also the unlimited one."""
    seen = x.real & ~x.upper
    top = np.where(seen[:, :, None], pred, -np.inf).max(0)
    raw = np.where((top > 1e-10) & np.isfinite(top), 1 / np.where(top > 0, top, 1), 1.0)
    return np.clip(raw, 0.1, 10.0), raw


def cost(model: Model, theta: np.ndarray, x: Stack) -> np.ndarray:
    """(bands, rows) swarm objective."""
    with np.errstate(all="ignore"):
        pred = flux(model, theta, x.t)
        if model.flux is None:
            pred *= rescale(pred, x)[0]
        var = (x.s**2)[:, :, None] + np.exp(2 * theta[:, :, -1]) + VAR_FLOOR
        each = pred - x.y[:, :, None]
        each *= each
        each /= var
        each += np.log(var)
        p, b = x.limits()
        each[p, b] = -log_normal_cdf_numpy((x.ceiling[p, b, None] - pred[p, b]) / np.sqrt(var[p, b]))
        each[~x.real] = 0.0
        pred[~x.real] = 0.0
        out = each.sum(0) / x.real.sum(0)[:, None]
    return np.where(np.isfinite(pred).all(0), out, 1e99)


def start_values(model: Model, x: Stack) -> np.ndarray:
    """(bands, parameters) heuristic values from the brightest point."""
    theta = np.tile(np.array(model.start, float), (len(x), 1))
    top = np.where(x.real, x.y, -np.inf).argmax(0)
    bands = np.arange(len(x))
    theta[:, model.t0] = x.t[top, bands] - theta[:, model.t0]
    if model.params[0] == "log_a":
        theta[:, 0] = np.log(np.maximum(x.y[top, bands], 0.01))
    return np.clip(theta, model.lower, model.upper)


def swarm(model: Model, x: Stack, iterations: int = ITERATIONS, fixed_t0: np.ndarray | None = None, purpose: str = "swarm") -> tuple[np.ndarray, np.ndarray]:
    """Best parameters and cost of each band, found by ``PARTICLES`` particles within the model's bounds."""
    lo, hi = np.array(model.lower, float), np.array(model.upper, float)
    r = x.draws(purpose + model.name, "random", (2 * iterations + 1, PARTICLES, len(lo)))
    pin = lambda z: z if fixed_t0 is None else np.where(np.arange(len(lo)) == model.t0, fixed_t0[:, None, None], z)
    at = lo + r[:, 0] * (hi - lo)
    at[:, 0] = start_values(model, x)
    at = pin(at)
    v = np.zeros_like(at)
    own, own_cost = at.copy(), cost(model, at, x)
    bands = np.arange(len(x))
    for k in range(iterations):
        lead = own[bands, own_cost.argmin(1)][:, None]
        v = INERTIA * v + PULL * r[:, 2 * k + 1] * (own - at) + PULL * r[:, 2 * k + 2] * (lead - at)
        at = pin(np.clip(at + v, lo, hi))
        c = cost(model, at, x)
        better = c < own_cost
        own[better], own_cost[better] = at[better], c[better]
    k = own_cost.argmin(1)
    return own[bands, k], own_cost[bands, k]


def select(x: Stack, only: str | None = None) -> tuple[list[Model], list[np.ndarray], np.ndarray]:
    """Models in their order of trial; the cheapest wins, and a cost below ``GOOD_ENOUGH`` ends a band's search."""
    models, thetas, best = [None] * len(x), [None] * len(x), np.full(len(x), np.inf)
    open_ = np.arange(len(x))
    for model in [MODELS[only]] if only else MODELS.values():
        for some in _pieces(open_, SWARM_BANDS if model.flux else CURVE_BANDS):
            theta, c = swarm(model, x.take(some))
            for i, k in enumerate(some):
                if models[k] is None or c[i] < best[k]:
                    models[k], thetas[k], best[k] = model, theta[i], c[i]
        open_ = open_[best[open_] >= GOOD_ENOUGH]
        if not len(open_):
            break
    return models, thetas, best


def search_onset(model: Model, theta: np.ndarray, c: np.ndarray, x: Stack) -> tuple[np.ndarray, np.ndarray]:
    """Swarm searches of all other parameters at fixed onsets: ten around the pilot, then five around the best."""
    best, best_cost, onset = theta.copy(), c.copy(), theta[:, model.t0].copy()
    lo, hi = np.maximum(onset - 5, x.t.min(0) - 10), onset + 5
    for turn, n in enumerate((10, 5)):
        a, b = (lo, hi) if turn == 0 else (np.maximum(onset - 0.5, lo), np.minimum(onset + 0.5, hi))
        for k, t0 in enumerate(np.linspace(a, b, n)):
            found, found_cost = swarm(model, x, ONSET_ITERATIONS, t0, f"onset{turn}.{k}")
            better = found_cost < best_cost
            best[better], best_cost[better], onset[better] = found[better], found_cost[better], t0[better]
    return best, best_cost


def _score(model: Model, theta: np.ndarray, x: Stack) -> tuple[np.ndarray, np.ndarray, tuple]:
    """For each band and row the log likelihood's gradient and whether the row counts; also fluxes and variances, and which points count."""
    with np.errstate(all="ignore"):
        pred, grad = flux_gradient(model, theta, x.t)
        counts = None
        if model.flux is None:
            scale, raw = rescale(pred, x)
            counts = np.abs(raw - scale) / raw <= 0.5
            pred, grad = pred * scale, [g * scale for g in grad]
        extra = np.exp(2 * theta[:, :, -1])
        var = (x.s**2 + VAR_FLOOR)[:, :, None] + extra
        r = x.y[:, :, None] - pred
        d_pred = r / var
        each = r * d_pred
        ok = np.isfinite(pred) & np.isfinite(each) & np.isfinite(var) & x.real[:, :, None]
        d_noise = (each - 1) / var * extra
        p, b = x.limits()
        if len(p):
            sd = np.sqrt(var[p, b])
            z = (x.ceiling[p, b, None] - pred[p, b]) / sd
            log_cdf = log_normal_cdf_numpy(z)
            ratio = np.exp(np.clip(-0.5 * z * z - 0.5 * math.log(2 * math.pi) - log_cdf, -700, 700))
            d_pred[p, b], d_noise[p, b] = -ratio / sd, -ratio * z * extra[b] / var[p, b]
            ok[p, b] = np.isfinite(pred[p, b]) & np.isfinite(log_cdf)
        if not ok.all():
            d_pred, d_noise = np.where(ok, d_pred, 0), np.where(ok, d_noise, 0)
        total = np.empty(theta.shape)
        for k, g in enumerate(grad):
            total[:, :, k] = (d_pred * g).sum(0)
            if not np.isfinite(total[:, :, k]).all():
                total[:, :, k] = (d_pred * np.nan_to_num(g, posinf=0, neginf=0)).sum(0)
        total[:, :, -1] += d_noise.sum(0)
    return total, np.ones(theta.shape[:2], bool) if counts is None else counts, (pred, var, ok)


def _likelihood(pred: np.ndarray, var: np.ndarray, ok: np.ndarray, x: Stack) -> np.ndarray:
    """(bands, rows) log likelihood of the points that count."""
    with np.errstate(all="ignore"):
        ll = -0.5 * ((x.y[:, :, None] - pred) ** 2 / var + np.log(2 * math.pi * var))
        p, b = x.limits()
        ll[p, b] = log_normal_cdf_numpy((x.ceiling[p, b, None] - pred[p, b]) / np.sqrt(var[p, b]))
    return np.where(ok, ll, 0).sum(0)


def variational(model: Model, x: Stack, start: np.ndarray, steps: int = 1000, samples: int = 4, rate: np.ndarray | float = 0.01, purpose: str = "posterior") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and log deviations of a diagonal Gaussian posterior of each band, and the last evidence bound."""
    k = start.shape[1]
    centre, width = np.array(model.priors()).T
    at = np.concatenate([start, np.full(start.shape, -1.0)], 1)
    first, second, elbo = np.zeros(at.shape), np.zeros(at.shape), np.full(len(x), -np.inf)
    draws = x.draws(purpose + model.name, "standard_normal", (steps, samples, k))
    for step in range(1, steps + 1):
        mu, log_s = at[:, None, :k], at[:, None, k:]
        eps = draws[:, step - 1]
        theta = mu + np.exp(log_s) * eps
        grad, counts, fit = _score(model, theta, x)
        pull = (theta - centre) / width
        grad = np.where(counts[:, :, None], grad - pull / width, 0.0)
        g_log = (grad * np.exp(log_s) * eps).sum(1) / samples + 1.0
        if step == steps:
            ll = _likelihood(*fit, x)
            elbo = np.where(counts, ll - 0.5 * (pull**2).sum(2), 0).sum(1) / samples + at[:, k:].sum(1) + 0.5 * k * math.log(2 * math.pi * math.e)
        g = -np.concatenate([grad.sum(1) / samples, g_log], 1)
        ok = np.isfinite(g)
        g = np.clip(np.where(ok, g, 0.0), -1e100, 1e100)
        first, second = np.where(ok, 0.9 * first + 0.1 * g, first), np.where(ok, 0.999 * second + 0.001 * g * g, second)
        at = at - np.where(ok, rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8), 0.0)
        at[:, k:] = np.clip(at[:, k:], -6.0, 2.0)
    return at[:, :k], at[:, k:] + math.log(INFLATION), elbo


def fit_bands(bands: list[Band], seeds: list[int], steps: int = 1000, samples: int = 4, rate: float = 0.01, retry: bool = False, only: str | None = None, onset_search: bool = False) -> Iterator[tuple[int, dict]]:
    """(place, selected model with swarm and posterior parameters) of each band, in any order."""
    widths = np.array([padded(b) for b in bands])
    of = lambda place: Stack([bands[k] for k in place], [seeds[k] for k in place])
    for width in np.unique(widths):
        place = np.flatnonzero(widths == width)
        models, thetas, costs = select(of(place), only)
        for model in {m.name: m for m in models}.values():
            for own in _pieces(np.flatnonzero([m is model for m in models]), POSTERIOR_BANDS):
                some, theta, c = of(place[own]), np.stack([thetas[k] for k in own]), costs[own]
                if onset_search:
                    theta, c = search_onset(model, theta, c, some)
                mu, log_s, elbo = variational(model, some, theta, steps, samples, rate)
                poor = np.flatnonzero(elbo < RETRY_BELOW) if retry else np.zeros(0, int)
                if len(poor):
                    again = variational(model, some.take(poor), theta[poor], steps, max(samples, 8), 0.005 if rate > 0.005 else rate * 2, "again")
                    better = again[2] > elbo[poor]
                    mu[poor[better]], log_s[poor[better]], elbo[poor[better]] = (z[better] for z in again)
                for i, k in enumerate(own):
                    yield int(place[k]), {"model": model.name, "cost": float(c[i]), "theta": theta[i], "mu": mu[i], "sigma": np.exp(log_s[i]), "elbo": float(elbo[i])}


def _pieces(place: np.ndarray, size: int) -> list[np.ndarray]:
    return np.array_split(place, math.ceil(len(place) / size))


def fit_band(band: Band, seed: int, **options) -> dict:
    """Selected model with swarm and posterior parameters of one band."""
    ((_, fit),) = fit_bands([band], [seed], **options)
    return fit


def refine_onset(model: Model, mu: np.ndarray, band: Band, points: int = 50) -> tuple[float, float, np.ndarray]:
    """Onset of highest profile likelihood, half the width of its half-unit interval, and the means with it."""
    bright = band.t[band.y.argmax()]
    grid = np.linspace(band.t.min() - 30, bright + 5, points)
    theta = np.tile(mu, (points, 1))
    theta[:, model.t0] = grid
    pred = flux_numpy(model, theta, band.t)
    with np.errstate(all="ignore"):
        var = band.s**2 + VAR_FLOOR + math.exp(2 * mu[-1])
        if model.params[0] == "log_a":
            base = mu[model.params.index("b")] if "b" in model.params else 0.0
            shape = (pred - base) / math.exp(mu[0])
            use = ~band.upper & np.isfinite(shape)
            w = np.where(use, 1 / var, 0.0)
            f = np.where(use, shape, 0.0)
            ff, fy, f1, y1, w1 = (w * f * f).sum(1), (w * f * band.y).sum(1), (w * f).sum(1), (w * band.y).sum(1), w.sum(1)
            if "b" in model.params:
                det = ff * w1 - f1**2
                a, b = (fy * w1 - f1 * y1) / det, (ff * y1 - f1 * fy) / det
                ok = (np.abs(det) > 1e-20) & (a > 1e-10)
                a, b = np.where(ok, a, math.exp(mu[0])), np.where(ok, b, base)
            else:
                a, b = fy / ff, np.zeros(points)
                a = np.where((ff > 1e-20) & (a > 1e-10), a, math.exp(mu[0]))
            pred = a[:, None] * shape + b[:, None]
        elif not band.upper.all():
            # The integrated model is scaled to a peak of one at detections, as in the fit.
            top = pred[:, ~band.upper].max(1)
            pred = pred * np.where((top > 1e-10) & np.isfinite(top), np.clip(1 / np.where(top > 0, top, 1), 0.1, 10.0), 1.0)[:, None]
        z = (band.ceiling - pred) / np.sqrt(var)
        ll = np.where(band.upper, log_normal_cdf_numpy(z), -0.5 * ((band.y - pred) ** 2 / var + np.log(2 * math.pi * var)))
    ll = np.where(np.isfinite(ll), ll, 0).sum(1)
    near = grid[ll >= ll.max() - 0.5]
    out = mu.copy()
    out[model.t0] = grid[ll.argmax()]
    return float(grid[ll.argmax()]), max((near[-1] - near[0]) / 2, 0.01), out


def posterior_bands(model: Model, mu: np.ndarray, sigma: np.ndarray, times: np.ndarray, peak: float, zero_point: float, rng: np.random.Generator, draws: int = 200) -> np.ndarray:
    """(3, n) magnitudes at the 16th, 50th and 84th percentile of posterior draws."""
    theta = mu + sigma * rng.standard_normal((draws, len(mu)))
    with np.errstate(all="ignore"):
        flux = flux_numpy(model, theta, times) * peak
    flux = np.maximum(np.nan_to_num(flux, nan=1e-12, posinf=1e-12, neginf=1e-12), 1e-12)
    mags = np.sort(-2.5 * np.log10(flux) + zero_point, axis=0)
    return mags[[int(draws * 0.16), draws // 2, int(draws * 0.84)]]
