"""Catalogue flags of an alert: rock, star and near a bright star.

Missing scores count as 0, missing distances and magnitudes as infinitely
large; all comparisons are made in single precision.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORES = ("sgscore1", "sgscore2", "sgscore3")
DISTANCES = ("ssdistnr", "ssmagnr", "distpsnr1", "distpsnr2", "distpsnr3", "srmag1", "srmag2", "srmag3", "sgmag1", "simag1", "szmag1", "neargaiabright", "maggaiabright")


def _f(x: float) -> Column:
    return F.lit(x).cast("float")


def _between(x: Column, lo: float, hi: float) -> Column:
    return (x >= _f(lo)) & (x <= _f(hi))


def _exceeds(a: Column, b: Column, by: float) -> Column:
    """a - b > by as IEEE has it: false where the difference of two infinities is not a number."""
    d = a - b
    return ~F.isnan(d) & (d > _f(by))


def alert_flags(alerts: DataFrame) -> DataFrame:
    """Add booleans rock, star and near_brightstar."""
    v = {c: F.coalesce(F.col(c).cast("float"), _f(0.0)) for c in SCORES} | {c: F.coalesce(F.col(c).cast("float"), _f(float("inf"))) for c in DISTANCES}
    rock = (v["ssdistnr"] >= _f(0)) & (v["ssdistnr"] < _f(12)) & (v["ssmagnr"] >= _f(0))
    red = [(v[m] > _f(0)) & _exceeds(v["srmag1"], v[m], 3) for m in ("szmag1", "simag1")]
    star = ((v["sgscore1"] > _f(0.76)) & _between(v["distpsnr1"], 0, 2)) | ((v["sgscore1"] > _f(0.2)) & _between(v["distpsnr1"], 0, 1) & (v["srmag1"] > _f(0)) & (red[0] | red[1]))
    neighbours = [(v[f"sgscore{k}"] > _f(0.49)) & (v[f"distpsnr{k}"] <= _f(20)) & (v[f"srmag{k}"] > _f(0)) & (v[f"srmag{k}"] <= _f(15)) for k in (1, 2, 3)]
    unsure = (v["sgscore1"] == _f(0.5)) & (v["distpsnr1"] < _f(0.5)) & ((v["sgmag1"] < _f(17)) | (v["srmag1"] < _f(17)) | (v["simag1"] < _f(17)))
    gaia = _between(v["neargaiabright"], 0, 20) & (v["maggaiabright"] > _f(0)) & (v["maggaiabright"] <= _f(12))
    near = reduce(lambda a, b: a | b, [gaia, *neighbours, unsure])
    return alerts.withColumns({"rock": rock, "star": star, "near_brightstar": near})
