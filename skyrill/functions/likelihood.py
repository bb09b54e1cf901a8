"""The normal distribution's logarithm for upper limits, and swarm cost terms, as columns and in numpy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of formula 7.1.26 of Abramowitz and Stegun.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
VAR_FLOOR = 1e-10


def _tail(z, exp, absolute):
    """erfc of |z|."""
    t = 1.0 / (1.0 + ERF_P * absolute(z))
    poly = t * 0.0
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return poly * exp(-(z * z))


def erf(x: Column) -> Column:
    """The error function of a column, to about 1e-7."""
    v = F.lit(1.0) - _tail(x, F.exp, F.abs)
    return F.when(x >= 0, v).otherwise(-v)


def log_normal_cdf(x: Column) -> Column:
    """ln of the normal distribution function: 0 above 8, the asymptotic tail below -30."""
    z = x * (-math.sqrt(0.5))
    e = _tail(z, F.exp, F.abs)
    phi = F.when(z >= 0, e * 0.5).otherwise(F.lit(1.0) - e * 0.5)
    low = x * x * -0.5 - 0.5 * math.log(2 * math.pi) - F.log(-x)
    return F.when(x > 8, 0.0).when(x < -30, low).otherwise(F.log(F.greatest(phi, F.lit(1e-300))))


def log_normal_cdf_sql(x: str) -> str:
    """``log_normal_cdf`` as SQL text, for any dialect with exp, ln, abs and greatest."""
    z = f"(-({x}) * {math.sqrt(0.5)!r})"
    t = f"(1.0 / (1.0 + {ERF_P} * abs{z}))"
    poly = "0.0"
    for a in reversed(ERF_A):
        poly = f"(({poly} + {a}) * {t})"
    e = f"({poly} * exp(-({z} * {z})))"
    phi = f"(CASE WHEN {z} >= 0 THEN 0.5 * {e} ELSE 1.0 - 0.5 * {e} END)"
    low = f"(-0.5 * ({x}) * ({x}) - 0.5 * {math.log(2 * math.pi)!r} - ln(CASE WHEN ({x}) < 0 THEN -({x}) ELSE 1.0 END))"
    return f"(CASE WHEN ({x}) > 8 THEN 0.0 WHEN ({x}) < -30 THEN {low} ELSE ln(greatest({phi}, 1e-300)) END)"


def log_normal_cdf_numpy(x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        z = x * -math.sqrt(0.5)
        e = _tail(z, np.exp, np.abs)
        phi = np.where(z >= 0, e * 0.5, 1 - e * 0.5)
        low = -0.5 * x * x - 0.5 * math.log(2 * math.pi) - np.log(np.where(x < 0, -x, 1.0))
        return np.where(x > 8, 0.0, np.where(x < -30, low, np.log(np.maximum(phi, 1e-300))))


def cost_term(pred: Column, y: Column, s: Column, is_upper: Column, ceiling: Column, log_sigma: float) -> Column:
    """One observation's share of the swarm objective: detections carry twice the scale of limits."""
    var = s * s + F.lit(math.exp(2 * log_sigma) + VAR_FLOOR)
    return F.when(is_upper, -log_normal_cdf((ceiling - pred) / F.sqrt(var))).otherwise((pred - y) * (pred - y) / var + F.log(var))
