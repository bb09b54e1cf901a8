"""Column helpers: missing-value hygiene, medians, first-tie extremes and magnitudes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero points of fluxes in microjansky and in nanojansky, and the factor from relative flux error to magnitude error.
ZP_MICRO, ZP_NANO, POGSON = 23.9, 31.4, 1.0857


def finite(x: Column) -> Column:
    """``x`` with NaN and both infinities turned to null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def flux_to_mag(flux: Column, zero_point: float | Column = ZP_MICRO) -> Column:
    """Magnitude of a positive flux, else null."""
    return F.when(flux > 0, F.lit(-2.5) * F.log10(flux) + zero_point)


def flux_to_mag_err(flux: Column, err: Column) -> Column:
    return F.when(flux > 0, F.lit(POGSON) * err / flux)


def upper_median(values: Column) -> Column:
    """Element floor(n / 2) of an array in ascending order; null for an empty one."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def first_min(*cols: str) -> Column:
    """The struct of ``cols`` that is smallest by the first column, then by the next ones: a mergeable arg-min with fixed ties."""
    return F.min(F.struct(*cols))


def time_to_mjd(ts: Column) -> Column:
    """Modified Julian date of a timestamp without time zone."""
    return F.lit(40587) + F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / F.lit(86400e6)
