"""Flux models of transients, written once and evaluated by three back ends.

A model is a function of ``ops`` (the elementary functions of a back end), its
parameters and time. The back ends are Spark columns, numpy arrays and SQL
text. Gradients come from dual numbers over any back end, so no derivative is
written by hand.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .kilonova import kilonova


class ColumnOps:
    """Spark column expressions."""

    exp, log, log1p = staticmethod(F.exp), staticmethod(F.log), staticmethod(F.log1p)
    where = staticmethod(lambda c, a, b: F.when(c, a).otherwise(b))
    lift = staticmethod(lambda x: x if isinstance(x, Column) else F.lit(float(x)))


class NumpyOps:
    """numpy arrays; overflow to infinity is intended and silent."""

    exp, log, log1p = staticmethod(np.exp), staticmethod(np.log), staticmethod(np.log1p)
    where = staticmethod(np.where)
    lift = staticmethod(lambda x: x)


class Sql:
    """An SQL expression as text, with operators."""

    def __init__(self, text: str):
        self.text = text

    def __str__(self) -> str:
        return self.text

    def _two(self, op: str, other, swap: bool = False) -> Sql:
        a, b = (other, self) if swap else (self, other)
        return Sql(f"({a} {op} {b})")

    __add__, __radd__ = lambda s, o: s._two("+", o), lambda s, o: s._two("+", o, True)
    __sub__, __rsub__ = lambda s, o: s._two("-", o), lambda s, o: s._two("-", o, True)
    __mul__, __rmul__ = lambda s, o: s._two("*", o), lambda s, o: s._two("*", o, True)
    __truediv__, __rtruediv__ = lambda s, o: s._two("/", o), lambda s, o: s._two("/", o, True)
    __neg__ = lambda s: Sql(f"(-{s})")
    __gt__ = lambda s, o: s._two(">", o)


class SqlOps:
    exp = staticmethod(lambda x: Sql(f"exp({x})"))
    log = staticmethod(lambda x: Sql(f"ln({x})"))
    log1p = staticmethod(lambda x: Sql(f"ln(1.0 + {x})"))
    where = staticmethod(lambda c, a, b: Sql(f"(CASE WHEN {c} THEN {a} ELSE {b} END)"))
    lift = staticmethod(lambda x: x if isinstance(x, Sql) else Sql(repr(float(x))))


class Dual:
    """A value with its derivatives by parameter name."""

    __array_ufunc__ = None

    def __init__(self, v, d: dict):
        self.v, self.d = v, d

    @staticmethod
    def of(x) -> Dual:
        return x if isinstance(x, Dual) else Dual(x, {})

    def chain(self, v, slope) -> Dual:
        return Dual(v, {k: slope * g for k, g in self.d.items()})

    def __add__(self, o) -> Dual:
        o = Dual.of(o)
        d = dict(self.d)
        for k, g in o.d.items():
            d[k] = d[k] + g if k in d else g
        return Dual(self.v + o.v, d)

    def __mul__(self, o) -> Dual:
        o = Dual.of(o)
        d = {k: g * o.v for k, g in self.d.items()}
        for k, g in o.d.items():
            d[k] = d[k] + self.v * g if k in d else self.v * g
        return Dual(self.v * o.v, d)

    __radd__, __rmul__ = __add__, __mul__

    def __neg__(self) -> Dual:
        return self * -1.0

    def __sub__(self, o) -> Dual:
        return self + (-Dual.of(o))

    def __rsub__(self, o) -> Dual:
        return (-self) + o

    def __truediv__(self, o) -> Dual:
        o = Dual.of(o)
        return self * o.chain(1.0 / o.v, -1.0 / (o.v * o.v))

    def __rtruediv__(self, o) -> Dual:
        return Dual.of(o) / self

    def __gt__(self, o):
        return self.v > o


class DualOps:
    """Elementary functions of dual numbers over the functions of ``base``."""

    def __init__(self, base):
        self.base = base

    def lift(self, x):
        return x if isinstance(x, Dual) else self.base.lift(x)

    def exp(self, x):
        e = self.base.exp(Dual.of(x).v)
        return Dual.of(x).chain(e, e)

    def log(self, x):
        x = Dual.of(x)
        return x.chain(self.base.log(x.v), 1.0 / x.v)

    def log1p(self, x):
        x = Dual.of(x)
        return x.chain(self.base.log1p(x.v), 1.0 / (1.0 + x.v))

    def where(self, c, a, b):
        a, b = Dual.of(a), Dual.of(b)
        zero = 0.0
        return Dual(self.base.where(c, a.v, b.v), {k: self.base.where(c, a.d.get(k, zero), b.d.get(k, zero)) for k in {*a.d, *b.d}})


def sigmoid(o, x):
    return 1.0 / (1.0 + o.exp(-x))


def softplus(o, x):
    """ln(1 + e^x) + 1e-6 without overflow."""
    return o.where(x > 30.0, x, o.log1p(o.exp(o.where(x > 30.0, x * 0.0, x)))) + 1e-6


def power(o, x, p):
    return o.exp(p * o.log(x))


def bazin(o, p, t):
    dt = t - p["t0"]
    return o.exp(p["log_a"] - dt / o.exp(p["log_tau_fall"])) * sigmoid(o, dt / o.exp(p["log_tau_rise"])) + p["b"]


def villar(o, p, t):
    dt, gamma, beta = t - p["t0"], o.exp(p["log_gamma"]), p["beta"]
    late = sigmoid(o, (dt - gamma) * 10.0)
    tail = (1.0 - beta * gamma) * o.exp((gamma - dt) / o.exp(p["log_tau_fall"]))
    plateau = 1.0 - beta * dt
    return o.exp(p["log_a"]) * sigmoid(o, dt / o.exp(p["log_tau_rise"])) * (plateau + late * (tail - plateau))


def tde(o, p, t):
    dt = t - p["t0"]
    fall = power(o, 1.0 + softplus(o, dt) / o.exp(p["log_tau_fall"]), -p["alpha"])
    return o.exp(p["log_a"]) * sigmoid(o, dt / o.exp(p["log_tau_rise"])) * fall + p["b"]


def _trapped(o, s, log_tau):
    x = s / o.exp(log_tau)
    return 1.0 - o.exp(-(x * x))


#: Decay times of nickel-56 and cobalt-56 in days.
TAU_NICKEL, TAU_COBALT = 8.8, 111.3


def arnett(o, p, t):
    s, f = softplus(o, t - p["t0"]), sigmoid(o, p["logit_f"])
    cobalt = o.exp(s * (-1.0 / TAU_COBALT))
    heat = cobalt + f * (o.exp(s * (-1.0 / TAU_NICKEL)) - cobalt)
    return o.exp(p["log_a"]) * heat * _trapped(o, s, p["log_tau_m"])


def magnetar(o, p, t):
    s = softplus(o, t - p["t0"])
    w = 1.0 + s / o.exp(p["log_tau_sd"])
    return o.exp(p["log_a"]) / (w * w) * _trapped(o, s, p["log_tau_diff"])


def shock_cooling(o, p, t):
    dt = t - p["t0"]
    s = softplus(o, dt)
    x = s / o.exp(p["log_tau_tr"])
    return o.exp(p["log_a"] - p["n"] * o.log(s) - x * x) * sigmoid(o, dt * 5.0)


def afterglow(o, p, t):
    ln_r = o.log(softplus(o, t - p["t0"])) - p["log_t_b"]
    u = o.exp(2.0 * p["alpha1"] * ln_r) + o.exp(2.0 * p["alpha2"] * ln_r)
    return o.exp(p["log_a"] - 0.5 * o.log(u))


@dataclass(frozen=True)
class Model:
    """A flux model: parameters in order (the last, log_sigma_extra, is noise), bounds, priors and start values.

    ``start`` holds values for the parameters between amplitude and noise; the
    start of t0 is that many days before the brightest point.
    """

    name: str
    flux: Callable | None
    params: tuple[str, ...]
    lower: tuple[float, ...]
    upper: tuple[float, ...]
    start: tuple[float, ...]
    prior: dict

    @property
    def t0(self) -> int:
        return self.params.index("t0")

    def evaluate(self, ops, values, t):
        return self.flux(ops, dict(zip(self.params, map(ops.lift, values))), t)

    def gradient(self, ops, values, t) -> dict:
        """Derivatives of the flux by each parameter (0 for the noise)."""
        p = {k: Dual(ops.lift(v), {k: ops.lift(1.0)}) for k, v in zip(self.params, values)}
        d = Dual.of(self.flux(DualOps(ops), p, Dual.of(t))).d
        return {k: d.get(k, ops.lift(0.0)) for k in self.params}

    def priors(self) -> list[tuple[float, float]]:
        return [self.prior.get(k, (0.0, 2.0)) for k in self.params]


LSE = "log_sigma_extra"
_ln = math.log
# Parameter order, search bounds, prior centres and widths, start values, and the order of trial.
MODELS = {
    m.name: m
    for m in (
        Model("Bazin", bazin, ("log_a", "b", "t0", "log_tau_rise", "log_tau_fall", LSE), (-3, -1, -100, -2, -2, -5), (3, 1, 100, 5, 6, 0), (0, 0, 0, _ln(2), _ln(20), -3), {}),
        Model("Arnett", arnett, ("log_a", "t0", "log_tau_m", "logit_f", LSE), (-3, -100, 0.5, -3, -5), (3, 100, 4.5, 3, 0), (0, 15, _ln(10), 0, -3), {"log_tau_m": (2.3, 1)}),
        Model("Tde", tde, ("log_a", "b", "t0", "log_tau_rise", "log_tau_fall", "alpha", LSE), (-3, -1, -100, -2, -1, 0.5, -5), (3, 1, 100, 5, 6, 4, 0), (0, 0, 10, _ln(2), _ln(20), 1.67, -3), {"alpha": (1.67, 1)}),
        Model("Afterglow", afterglow, ("log_a", "t0", "log_t_b", "alpha1", "alpha2", LSE), (-3, -100, -2, -2, 0.5, -5), (3, 100, 6, 3, 5, 0), (0, 5, _ln(10), 0.8, 2.2, -3), {"log_t_b": (1, 2), "alpha1": (0.8, 1), "alpha2": (2, 1)}),
        Model("Villar", villar, ("log_a", "beta", "log_gamma", "t0", "log_tau_rise", "log_tau_fall", LSE), (-3, -0.05, -3, -100, -2, -2, -5), (3, 0.1, 5, 100, 5, 7, 0), (0, 0.01, _ln(10), 0, _ln(2), _ln(20), -3), {}),
        Model("Magnetar", magnetar, ("log_a", "t0", "log_tau_sd", "log_tau_diff", LSE), (-3, -100, 0, 0.5, -5), (3, 100, 6, 4.5, 0), (0, 10, _ln(20), _ln(10), -3), {"log_tau_sd": (3, 1.5), "log_tau_diff": (2.3, 1)}),
        Model("ShockCooling", shock_cooling, ("log_a", "t0", "n", "log_tau_tr", LSE), (-3, -100, 0.1, -1, -5), (3, 100, 3, 4, 0), (0, 2, 0.5, _ln(5), -3), {"n": (0.5, 1), "log_tau_tr": (1, 2)}),
        Model("MetzgerKN", None, ("log10_mej", "log10_vej", "log10_kappa_r", "t0", LSE), (-3, -2, -1, -2, -5), (-0.5, -0.5, 2, 1, 0), (-2, -0.7, 0.5, 2, -3), {"log10_mej": (-1.75, 1.25), "log10_vej": (-1.25, 0.75), "log10_kappa_r": (0.5, 1.5), "t0": (-0.5, 1.5)}),
    )
}
CLOSED_FORM = [m for m in MODELS.values() if m.flux]

def flux_numpy(model: Model, theta: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Fluxes of parameter rows at n times: (P, n) for (P, k) rows, or (..., n) for (k, ...) parameters whose shape meets that of ``t``."""
    if model.flux is None:
        return kilonova(theta, t)
    values, t = _aligned(theta, t)
    with np.errstate(all="ignore"):
        return model.evaluate(NumpyOps, values, t) + np.zeros(np.broadcast_shapes(values[0].shape, t.shape))


def _aligned(theta: np.ndarray, t: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    if theta.ndim == 2:
        return [theta[:, [k]] for k in range(theta.shape[1])], np.atleast_2d(t)
    return [x[..., None] for x in theta], t


def gradient_numpy(model: Model, theta: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``flux_numpy`` and its derivatives on a last axis; forward differences of 1e-5 for the integrated model."""
    if model.flux is None:
        # A row beside its moved copies, which share what follows from its times.
        moved = (theta[:, None] + np.concatenate([np.zeros((1, 5)), 1e-5 * np.eye(5)[:4]])).reshape(-1, 5)
        f = kilonova(moved, np.repeat(np.broadcast_to(t, (len(theta), np.shape(t)[-1])), 5, axis=0)).reshape(len(theta), 5, -1)
        out = np.zeros((len(theta), f.shape[2], 5))
        out[:, :, :4] = np.moveaxis((f[:, 1:] - f[:, :1]) / 1e-5, 1, 2)
        return f[:, 0], out
    values, t = _aligned(theta, t)
    shape = np.broadcast_shapes(values[0].shape, t.shape)
    with np.errstate(all="ignore"):
        p = {k: Dual(x, {k: 1.0}) for k, x in zip(model.params, values)}
        f = model.flux(DualOps(NumpyOps), p, Dual.of(t))
        return f.v + np.zeros(shape), np.stack([f.d.get(k, 0.0) + np.zeros(shape) for k in model.params], -1)
