"""Light of a kilonova: one expanding zone, heated by decay, cooled by expansion and by escaping light.

Everything is in natural units of the ejecta: energies per rest energy, speed
over that of light, the radius in light seconds. Then with the thermal energy e,
the kinetic energy k, the radius r and the speed b = min(sqrt(2 k), 1)

    de/ds = h(s) - e b / r - e / T        dk/ds = e b / r        dr/ds = b
    T = 3 kappa(s) m / (4 pi c^2 b s) + r

where h is the heating per rest energy and T the time that light needs to leave;
the light is e / T, of which only the shape counts. Steps are explicit on a grid
that is even in the logarithm of time; a negative e is reflected, and r moves at
the speed after the step.

``kilonova`` has the curves of many parameter rows in numpy, for the fits;
``light`` has one curve as a column, stepped along the grid for a batch of rows at once.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cgs units of mass, speed and time, the grid, the composition, opacity and heating.
SUN, LIGHT, DAY = 1.989e33, 2.998e10, 86400.0
DAWN, STEPS, BEYOND = 0.01, 200, 1.05
#: Step and end of the table of heating, in the logarithm of time over ``DAWN``.
TABLE_STEP, TABLE_END = 1e-3, 20.0
#: Curves that are stepped together.
BLOCK = 1024
NEUTRONS, NEUTRON_LIFE, NEUTRON_HEAT, NEUTRON_OPACITY = 0.8, 900.0, 3.2e14, 0.4
PROCESS_HEAT, PROCESS_START, PROCESS_WIDTH, PROCESS_POWER = 2e18, 1.3, 0.11, 1.3
THERMAL_SHARE, THERMAL_RATE, THERMAL_FACTOR, THERMAL_POWER = 0.36, 0.56, 0.34, 0.74


def neutrons(s: np.ndarray) -> np.ndarray:
    """Share of free neutrons after s seconds."""
    return NEUTRONS * np.exp(-s / NEUTRON_LIFE)


def thermalised(day: np.ndarray) -> np.ndarray:
    """Share of the decay energy that becomes heat."""
    x = THERMAL_FACTOR * day**THERMAL_POWER
    return THERMAL_SHARE * (np.exp(-THERMAL_RATE * day) + np.log1p(x) / x)


def heating(s: np.ndarray) -> np.ndarray:
    """Heat per second and rest energy: decaying neutrons and the r-process."""
    started = 0.5 - np.arctan((s - PROCESS_START) / PROCESS_WIDTH) / np.pi
    return (NEUTRON_HEAT * neutrons(s) + PROCESS_HEAT * thermalised(s / DAY) * np.maximum(started, 1e-30) ** PROCESS_POWER) / LIGHT**2


def _curves(mass: np.ndarray, speed: np.ndarray, process: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seconds (STEPS, P) of the grid's points, and (P, STEPS) light over its peak.

    A step takes the thermal and kinetic energy, radius and speed over ``ds`` seconds of heat, at a depth that is the escape time at the speed of light, without the crossing.
    """
    # Curves of one span, as those of a gradient are, share their grid and what follows from it.
    ends, own = np.unique(span, return_inverse=True)
    if 2 * len(ends) > len(span):
        ends, own = span, slice(None)
    s = DAWN * DAY * np.exp(np.linspace(0.0, 1.0, STEPS)[:, None] * ends)
    heat, opaque, s = heating(s)[:, own], (NEUTRON_OPACITY * (NEUTRONS - neutrons(s)))[:, own], s[:, own]
    depth = 3.0 * (opaque + process * (1.0 - NEUTRONS)) * mass / (4.0 * np.pi * LIGHT**2 * s)
    steps = np.diff(s, axis=0)
    thermal = kinetic = speed**2 / 2.0
    radius = s[0] * speed
    out = np.empty(s.shape)
    for k in range(STEPS):
        out[k] = thermal / (depth[k] / speed + radius)
        if k < STEPS - 1:
            work = thermal * speed / radius
            thermal = np.abs(thermal + (heat[k] - work - out[k]) * steps[k])
            kinetic = kinetic + work * steps[k]
            speed = np.minimum(np.sqrt(2.0 * kinetic), 1.0)
            radius = radius + speed * steps[k]
    out = np.ascontiguousarray(out.T)
    return s, out / out.max(1, keepdims=True)


def kilonova(theta: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(P, n) light over its peak for P parameter rows (mass, speed, opacity as log10, onset) at n times (or at P rows of n times).

    Zero before the onset, and for rows without a time ``DAWN`` after it; constant beyond the grid's ends.
    """
    theta, t = np.atleast_2d(theta), np.atleast_2d(t)
    if len(theta) > BLOCK:
        pieces = (slice(k, k + BLOCK) for k in range(0, len(theta), BLOCK))
        return np.concatenate([kilonova(theta[part], t if len(t) == 1 else t[part]) for part in pieces])
    mass, speed, process = 10.0 ** theta[:, 0] * SUN, 10.0 ** theta[:, 1], 10.0 ** theta[:, 2]
    phase = t - theta[:, 3:4]
    if not phase.size:
        return np.zeros(phase.shape)
    last = phase.max(1)
    with np.errstate(all="ignore"):
        span = np.log(np.maximum(last, DAWN) * BEYOND / DAWN)
        s, light = _curves(mass, speed, process, span)
        # The grid is even in the logarithm of time, so the place of a phase is a quotient.
        place = np.clip(np.log(phase / DAWN) / span[:, None] * (STEPS - 1), 0, STEPS - 1)
        k = np.minimum(np.nan_to_num(place).astype(int), STEPS - 2)
        left, right = (np.take_along_axis(s.T / DAY, k + i, 1) for i in (0, 1))
        low, high = (np.take_along_axis(light, k + i, 1) for i in (0, 1))
        out = low + (high - low) * np.clip((phase - left) / (right - left), 0.0, 1.0)
    return np.where((phase > 0) & (last > DAWN)[:, None] & np.isfinite(out), out, 0.0)


@cache
def _heat_table() -> np.ndarray:
    """(3, n) parabolas of ``heating`` over even steps of ln(s / (DAWN days)), right to about 1e-10 of it."""
    x = np.arange(round(TABLE_END / TABLE_STEP) + 2) * TABLE_STEP
    low, mid, high = (heating(DAWN * DAY * np.exp(x + d)) for d in (0.0, TABLE_STEP / 2, TABLE_STEP))
    return np.stack([low, 4 * mid - 3 * low - high, 2 * (high + low - 2 * mid)])


def swift_kilonova(theta: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(n, bands, rows) values of ``kilonova`` for (bands, rows, parameters) at (n, bands) times, with heating from a table; for searches, which ask for many curves."""
    n, rows = theta.shape[:2]
    if len(t) * n * rows == 0:
        return np.zeros((len(t), n, rows))
    mass, speed, process, onset = (theta[:, :, k].reshape(-1) for k in range(4))
    phase = (t[:, :, None] - theta[None, :, :, 3]).reshape(len(t), -1)
    last = phase.max(0)
    with np.errstate(all="ignore"):
        span = np.log(np.maximum(last, DAWN) * BEYOND / DAWN)
        speed = 10.0**speed
        ejected = 3.0 * 10.0**mass * SUN / (4.0 * np.pi * LIGHT**2)
        late, early = ejected * (10.0**process * (1.0 - NEUTRONS) + NEUTRON_OPACITY * NEUTRONS), ejected * NEUTRON_OPACITY
        far, table = span.max() > TABLE_END, _heat_table()
        ratio, per_step = np.exp(span / (STEPS - 1)), span / ((STEPS - 1) * TABLE_STEP)
        grid, light = np.empty((STEPS, len(span))), np.empty((STEPS, len(span)))
        grid[0] = s = np.full(len(span), DAWN * DAY)
        thermal = kinetic = speed**2 / 2.0
        radius = s * speed
        for k in range(STEPS):
            if k:
                s = np.multiply(grid[k - 1], ratio, out=grid[k])
                heat -= work
                heat -= light[k - 1]
                ds = s - grid[k - 1]
                heat *= ds
                heat += thermal
                thermal = np.abs(heat, out=heat)
                work *= ds
                kinetic = kinetic + work
                speed = np.sqrt(kinetic * 2.0)
                np.minimum(speed, 1.0, out=speed)
                ds *= speed
                radius = radius + ds
            # Free neutrons are below rounding after 40 of their lives.
            depth = (late if s.min() > 40 * NEUTRON_LIFE else late - early * neutrons(s)) / (s * speed)
            depth += radius
            np.divide(thermal, depth, out=light[k])
            work = thermal * speed
            work /= radius
            if far:
                heat = heating(s)
            else:
                x = per_step * k
                at = x.astype(np.intp)
                x -= at
                heat = table[2].take(at, mode="clip")
                for column in table[1::-1]:
                    heat *= x
                    heat += column.take(at, mode="clip")
        place = np.clip(np.log(phase * (1 / DAWN)) * ((STEPS - 1) / span), 0, STEPS - 1)
        at = np.minimum(np.nan_to_num(place).astype(int), STEPS - 2) * len(span) + np.arange(len(span))
        left, right = (grid.reshape(-1).take(at + i) / DAY for i in (0, len(span)))
        peak = light.max(0)
        low, high = (light.reshape(-1).take(at + i) / peak for i in (0, len(span)))
        out = low + (high - low) * np.clip((phase - left) / (right - left), 0.0, 1.0)
        out[~((phase > 0) & (last > DAWN) & np.isfinite(out))] = 0.0
    return out.reshape(-1, n, rows)


def _grid_day(last: Column, k: Column) -> Column:
    """The day of grid point k, counted from the onset; the grid ends beyond ``last``."""
    return DAWN * F.exp(F.log(F.greatest(last, F.lit(DAWN)) * (BEYOND / DAWN)) * k / (STEPS - 1))


def light(theta: tuple[float, ...], last: Column) -> Column:
    """Array of the light over its peak at the grid's points, for the parameters (mass, speed, opacity as log10) and the last day of interest."""
    of = 10.0 ** np.array(theta[:3], float)[:, None]

    @F.arrow_udf("array<double>")
    def stepped(days: pa.Array) -> pa.Array:
        ends = np.asarray(days.to_numpy(zero_copy_only=False), float)
        parts = [np.zeros((0, STEPS))]
        with np.errstate(all="ignore"):
            for k in range(0, len(ends), BLOCK):
                span = np.log(np.maximum(ends[k : k + BLOCK], DAWN) * BEYOND / DAWN)
                parts.append(_curves(*(np.repeat(x, len(span)) for x in (of[0] * SUN, of[1], of[2])), span)[1])
        flat = np.concatenate(parts)
        return pa.ListArray.from_arrays(np.arange(len(ends) + 1, dtype=np.int32) * STEPS, pa.array(flat.reshape(-1)))

    return stepped(last.cast("double"))


def light_at(curve: Column, last: Column, phase: Column) -> Column:
    """Value of a ``light`` at a phase in days: zero before the onset and for curves that end before the grid begins."""
    place = F.least(F.greatest(F.log(phase / DAWN) / F.log(F.greatest(last, F.lit(DAWN)) * (BEYOND / DAWN)) * (STEPS - 1), F.lit(0.0)), F.lit(float(STEPS - 2)))
    k = F.floor(place).cast("int")
    left, right = _grid_day(last, k), _grid_day(last, k + 1)
    low, high = F.get(curve, k), F.get(curve, k + 1)
    value = low + (high - low) * F.least(F.greatest((phase - left) / (right - left), F.lit(0.0)), F.lit(1.0))
    return F.when((phase > 0) & (last > DAWN) & ~F.isnan(value) & (F.abs(value) != float("inf")), value).otherwise(0.0)


def with_kilonovas(rows: DataFrame, keys: list[str], thetas: dict[str, tuple[float, ...]], time: str = "t") -> DataFrame:
    """``rows`` with a column for each of ``thetas``: the light of each group's curve at its times; a theta ends with the onset.

    A group's curves are made once and meet the group's rows by their keys. Their table is as long as there are
    groups and many times wider than the ends it is made from, so it must not be broadcast by the size of these.
    """
    ends = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max(time).alias("__last"))
    last = {out: F.col("__last") - theta[3] for out, theta in thetas.items()}
    curves = ends.select("*", *[light(theta[:3], last[out]).alias(f"__light_{out}") for out, theta in thetas.items()])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    met = rows.join(curves.hint("merge"), same)
    lights = {out: light_at(F.col(f"__light_{out}"), last[out], F.col(time) - theta[3]) for out, theta in thetas.items()}
    return met.withColumns(lights).drop("__last", *[f"__light_{out}" for out in thetas], *[f"__{k}" for k in keys])


def with_kilonova(rows: DataFrame, keys: list[str], theta: tuple[float, ...], out: str, time: str = "t") -> DataFrame:
    """``with_kilonovas`` of one theta."""
    return with_kilonovas(rows, keys, {out: theta}, time)
