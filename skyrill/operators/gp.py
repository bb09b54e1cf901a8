"""Gaussian-process regression of one band's curve in numpy, with both candidate searches and the feature row."""

from __future__ import annotations

import math

import numpy as np

GRID = 50
AMPLITUDES = (0.05, 0.1, 0.2, 0.4)
LENGTH_DIVISORS = (4.0, 6.0, 8.0, 12.0, 16.0, 24.0)
NUGGETS = (1e-6, 1e-4)
WHITE = 1e-10
#: Points up to which candidates are solved as dense systems in any case, and points whose features are held at once beyond that.
DIRECT, BLOCK = 64, 16384
#: Magnitudes that a predicted peak may differ from the brightest point.
MAX_JUMP = 6.0
SHRINK, SCALE_LIMITS, STD_WEIGHT = 0.6, (0.05, 5.0), 0.6

FEATURES = (
    "rise_time_days decay_time_days t0_days peak_mag chi2 baseline_chi2 n_obs fwhm_days rise_rate_mag_per_day decay_rate_mag_per_day "
    "gp_dfdt_now gp_dfdt_next gp_d2fdt2_now gp_predicted_mag_1d gp_predicted_mag_2d gp_time_to_peak gp_extrap_slope gp_T_peak gp_T_now gp_dTdt_peak "
    "gp_dTdt_now gp_sigma_f gp_peak_to_peak gp_snr_max gp_dfdt_max gp_dfdt_min gp_frac_of_peak gp_post_var_mean gp_post_var_max gp_skewness gp_kurtosis gp_n_inflections"
).split()


class Fits:
    """All candidates (amplitude, length, noise) solved at once on one set of points."""

    def __init__(self, t: np.ndarray, y: np.ndarray, amp: np.ndarray, length: np.ndarray, noise: np.ndarray, normalise: bool):
        self.t, self.amp, self.length = t, amp, length
        self.mean, std = y.mean(), y.std()
        self.scale = std if normalise and std > 0 else 1.0
        k = self.kernel(t, t) + (noise[:, None, None] + WHITE) * np.eye(len(t))
        self.chol = np.linalg.cholesky(k)
        z = np.broadcast_to((y - self.mean) / self.scale, (len(amp), len(y)))[..., None]
        self.weights = np.linalg.solve(np.swapaxes(self.chol, 1, 2), np.linalg.solve(self.chol, z))[..., 0]

    def kernel(self, a: np.ndarray, b: np.ndarray, which: slice = slice(None)) -> np.ndarray:
        d = (a[:, None] - b[None, :]) ** 2
        return self.amp[which, None, None] * np.exp(-0.5 * d[None] / self.length[which, None, None] ** 2)

    def means(self, at: np.ndarray) -> np.ndarray:
        """(candidates, n) means alone, for which nothing is solved."""
        return self.mean + self.scale * (self.kernel(at, self.t) @ self.weights[..., None])[..., 0]

    def predict(self, at: np.ndarray, which: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(candidates, n) means and standard deviations of the candidates in ``which``."""
        k = self.kernel(at, self.t, which)
        half = np.linalg.solve(self.chol[which], np.swapaxes(k, 1, 2))
        var = np.maximum(self.amp[which, None] + WHITE - (half**2).sum(1), 0.0)
        return self.mean + self.scale * (k @ self.weights[which, :, None])[..., 0], self.scale * np.sqrt(var)


def nodes_of(width: float, length: float) -> int:
    """Chebyshev nodes that a kernel of a length needs over a range."""
    return math.ceil(4.5 * width / length) + 32


class LongFits:
    """``Fits`` of a long band, without a matrix of points by points.

    The kernel is smooth, so its values at enough Chebyshev nodes of the range give it everywhere, up to rounding: K = F F' with
    some hundred features a point. Turned to the axes of F'F, every amplitude and noise of a length is a division. All
    points are used, and cost and memory grow with their number (a block of features at a time).
    """

    def __init__(self, t: np.ndarray, y: np.ndarray, amp: np.ndarray, length: np.ndarray, noise: np.ndarray, reach: tuple[float, float]):
        self.amp, self.length, self.noise = amp, length, noise + WHITE
        self.mean, std = y.mean(), y.std()
        self.scale = std if std > 0 else 1.0
        self.lo, self.hi = min(reach[0], t.min()), max(reach[1], t.max())
        z = (y - self.mean) / self.scale
        self.axes: dict[float, tuple] = {}
        for x in np.unique(length):
            basis = self._basis(float(x))
            parts = [(f.T @ f, f.T @ z[at]) for at, f in self._blocks(t, basis)]
            g, turn = np.linalg.eigh(sum(p for p, _ in parts))
            self.axes[float(x)] = basis @ turn, np.maximum(g, 0.0), turn.T @ sum(p for _, p in parts)

    def _basis(self, length: float) -> np.ndarray:
        """From Chebyshev polynomials to features whose products are the kernel of unit amplitude."""
        m = nodes_of(self.hi - self.lo, length)
        nodes = np.cos(np.pi * (np.arange(m) + 0.5) / m)
        back = np.polynomial.chebyshev.chebvander(nodes, m - 1).T * (2 / m)
        back[0] /= 2
        w, v = np.linalg.eigh(np.exp(-0.5 * ((nodes[:, None] - nodes) * (self.hi - self.lo) / 2 / length) ** 2))
        return back @ (v * np.sqrt(np.maximum(w, 0.0)))

    def _blocks(self, at: np.ndarray, basis: np.ndarray):
        for k in range(0, len(at), BLOCK):
            part = slice(k, min(k + BLOCK, len(at)))
            yield part, np.polynomial.chebyshev.chebvander((2 * at[part] - self.lo - self.hi) / (self.hi - self.lo), len(basis) - 1) @ basis

    def means(self, at: np.ndarray) -> np.ndarray:
        return self.predict(at)[0]

    def predict(self, at: np.ndarray, which: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        amp, length, noise = self.amp[which], self.length[which], self.noise[which]
        mean, var = np.empty((len(amp), len(at))), np.empty((len(amp), len(at)))
        for x in np.unique(length):
            basis, g, fz = self.axes[float(x)]
            own = np.flatnonzero(length == x)
            shrink = amp[own, None] / (amp[own, None] * g + noise[own, None])
            for part, f in self._blocks(at, basis):
                mean[own, part] = (shrink * fz) @ f.T
                var[own, part] = (shrink * noise[own, None]) @ (f * f).T + WHITE
        return self.mean + self.scale * mean, self.scale * np.sqrt(var)


def solved(t: np.ndarray, y: np.ndarray, tried: list[tuple[float, float, float]], span: tuple[float, float]) -> Fits | LongFits:
    """The candidates ``tried`` on all points; a long band's may be asked within ``span`` and from a day before to three days after it."""
    columns = tuple(map(np.array, zip(*tried)))
    reach = span[0] - 1.0, span[1] + 3.0
    few = len(t) <= max(DIRECT, nodes_of(max(reach[1], t.max()) - min(reach[0], t.min()), columns[1].min()))
    return Fits(t, y, *columns, normalise=True) if few else LongFits(t, y, *columns, reach)


def thin(n: int, over: int = 30, to: int = 25) -> np.ndarray:
    """Ranks of evenly spread points of a curve, for callers that want fewer; no fit here uses them."""
    return np.arange(n) if n <= over else np.unique(np.floor((np.arange(to) + 0.5) * n / to).astype(int))


def slope(t: np.ndarray, m: np.ndarray) -> float:
    n = len(t)
    det = n * (t * t).sum() - t.sum() ** 2
    return (n * (t * m).sum() - t.sum() * m.sum()) / det if n >= 2 and abs(det) >= 1e-10 else math.nan


def timescales(t: np.ndarray, m: np.ndarray) -> dict[str, float]:
    """Time scales of a curve on a grid, NaN where undefined."""
    n, p = len(m), int(np.argmin(m))
    out = dict.fromkeys(("rise_time_days", "decay_time_days", "fwhm_days"), math.nan)
    if p > 0:
        base = m[: min(p, 3)].mean() if p > 1 else m[p] + 0.5
        to = base + (m[p] - base) * (1 - math.exp(-1))
        out["rise_time_days"] = t[p] - t[:p][np.abs(m[:p] - to).argmin()]
    if p < n - 1:
        end = min((p + n) // 2, n - 1)
        base = m[p + 1 : end + 1].sum() / max(end - p, 1)
        to = base + (m[p] - base) * math.exp(-1)
        out["decay_time_days"] = t[p + 1 :][np.abs(m[p + 1 :] - to).argmin()] - t[p]
    faint = np.flatnonzero(m >= m[p] + 0.75)
    before, after = faint[faint < p], faint[faint > p]
    if len(before) and len(after):
        out["fwhm_days"] = t[after[0]] - t[before[-1]]
    quarter = math.ceil(0.25 * n)
    early, late = min(max(quarter, 2), n - 1), min(max(quarter, 2), n)
    return out | {"t0_days": t[p], "peak_mag": m[p], "rise_rate_mag_per_day": slope(t[:early], m[:early]), "decay_rate_mag_per_day": slope(t[n - late :], m[n - late :])}


def curve_features(grid: np.ndarray, pred: np.ndarray, std: np.ndarray, near: np.ndarray, t_last: float, mag: np.ndarray, err: np.ndarray) -> dict[str, float]:
    """Shape and forecast features; ``near`` are predictions at t_last - 1 ... t_last + 3. Temperatures are not fitted and stay NaN."""
    out = dict.fromkeys(("gp_T_peak", "gp_T_now", "gp_dTdt_peak", "gp_dTdt_now", "gp_skewness", "gp_kurtosis", "gp_dfdt_max", "gp_dfdt_min", "gp_n_inflections"), math.nan)
    sd, dt = pred.std(), grid[1] - grid[0]
    if len(pred) > 3 and sd > 1e-10:
        z = (pred - pred.mean()) / sd
        out |= {"gp_skewness": (z**3).mean(), "gp_kurtosis": (z**4).mean() - 3}
    if dt > 0:
        d2 = np.diff(pred, 2) / dt**2
        big = np.abs(d2) > 1e-6
        turns = big[1:] & big[:-1] & (d2[1:] * d2[:-1] < 0)
        out |= {"gp_dfdt_max": np.diff(pred).max() / dt, "gp_dfdt_min": np.diff(pred).min() / dt, "gp_n_inflections": float(turns.sum())}
    return out | {
        "gp_dfdt_now": near[1] - near[0],
        "gp_dfdt_next": near[2] - near[1],
        "gp_d2fdt2_now": near[2] - 2 * near[1] + near[0],
        "gp_predicted_mag_1d": near[2],
        "gp_predicted_mag_2d": near[3],
        "gp_time_to_peak": grid[pred.argmin()] - t_last,
        "gp_extrap_slope": near[4] - near[3],
        "gp_sigma_f": sd,
        "gp_peak_to_peak": np.ptp(pred),
        "gp_snr_max": (np.abs(mag) / err).max(),
        "gp_frac_of_peak": pred[-1] / pred.min(),
        "gp_post_var_mean": (std**2).mean(),
        "gp_post_var_max": (std**2).max(),
    }


def fit_band(t: np.ndarray, mag: np.ndarray, err: np.ndarray, span: tuple[float, float], backend: str = "B") -> dict[str, float] | None:
    """Feature row of one band (times sorted, 5 points or more), or None when no candidate can be solved.

    ``span`` is the object's time range, which the grid covers. Every candidate is fitted to all points. Back end A
    searches lengths and noise with unit amplitude and keeps the least reduced chi2; back end
    B searches amplitudes too, keeps the least sum of residual and deviation, and
    falls back to one short length.
    """
    grid = np.linspace(span[0], span[1], GRID)
    duration = span[1] - span[0]
    spread = float((err**2).mean())
    step = np.sort(np.diff(t))
    shortest = max(2 * (step[len(step) // 2] if len(step) else 1.0), 0.1)
    lengths = [x for x in (max(duration / d, 0.1) for d in LENGTH_DIVISORS) if x >= shortest]
    amps = AMPLITUDES if backend == "B" else (1.0,)
    noises = [max(spread, n) for n in NUGGETS]
    tried = [(a, x, v) for a in amps for x in lengths for v in noises]
    best, fits = None, None
    if tried:
        try:
            fits = solved(t, mag, tried, span)
        except np.linalg.LinAlgError:
            fits = None
    if fits is not None:
        sane = np.abs(fits.means(grid).min(1) - mag.min()) <= MAX_JUMP
        if backend == "B":
            at, dev = fits.predict(t)
            score = np.sqrt(((mag - at) ** 2).mean(1)) + STD_WEIGHT * dev.mean(1)
        else:
            score = ((mag - fits.means(t)) ** 2 / (err**2 + 1e-10)).mean(1)
        score = np.where(sane & np.isfinite(score), score, np.inf)
        if np.isfinite(score.min()):
            best = int(score.argmin())
    if best is None:
        if backend != "B":
            return None
        weighted = np.where(t <= t.min() + 0.2 * np.ptp(t), err * 0.7, err)
        tried, best = [(0.2, min(max(t.max() / 16, 0.3), 12.0), max(float((weighted**2).mean()), 1e-5))], 0
        fits = solved(t, mag, tried, span)
    pick = lambda at: tuple(x[0] for x in fits.predict(at, slice(best, best + 1)))
    pred, std = pick(grid)
    at_obs, dev_obs = pick(t)
    rms = math.sqrt(((mag - at_obs) ** 2).mean())
    if backend == "B":
        if dev_obs.mean() > 1e-12:
            std = std * (SHRINK * min(max(rms / dev_obs.mean(), SCALE_LIMITS[0]), SCALE_LIMITS[1]))
        asked = np.clip(t[-1] + np.arange(-1.0, 4.0), grid[0], grid[-1])
        near = np.interp(asked, grid, pred) if duration > 0 else np.full(5, pred[0])
    else:
        std = np.full(GRID, rms)
        near, _ = pick(t[-1] + np.arange(-1.0, 4.0))
    var = err**2 + 1e-10
    row = {"chi2": ((mag - at_obs) ** 2 / var).mean(), "baseline_chi2": ((mag - mag.mean()) ** 2 / var).mean(), "n_obs": float(len(t))}
    row |= timescales(grid, pred) | curve_features(grid, pred, std, near, t[-1], mag, err)
    amp, length, noise = tried[best]
    return row | ({"gp_amp": amp, "gp_lengthscale": length, "gp_alpha": noise} if backend == "B" else {"gp_theta_init": length, "gp_nugget": noise})
