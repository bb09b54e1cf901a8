"""The engine in SQL text: views over the tables of a folder and SQL functions, for use through ``spark.sql`` alone.

``install`` makes temporary views (the standard tables, the light curves and
features derived from them, and results of operators) and temporary functions
(magnitudes, hygiene, the normal log-CDF, and ``flux_<model>`` for each
closed-form model: time first, then its parameters). Bodies are SQL
expressions, so the optimiser sees through every call and no worker process is
needed. Views are plans: nothing is read before a query asks for it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions import models as M
from ..functions.likelihood import log_normal_cdf_sql
from ..functions.numeric import POGSON, ZP_MICRO
from ..operators import features as feat
from ..operators import photometry, prep
from ..operators.flags import alert_flags
from . import views as v

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CURVES = (v.events_curve, v.events_mags, v.events_relative, v.items_curve, v.daily_curve, v.alerts, v.features)
#: Results of operators as views.
RESULTS = {
    "band_extremes": lambda s, d: photometry.band_extremes(v.events_mags(s, d)),
    "band_rates": lambda s, d: photometry.band_rates(v.events_mags(s, d)),
    "alert_flags": lambda s, d: alert_flags(v.alerts(s, d)),
    "prepared": lambda s, d: prep.prepare(v.items_curve(s, d)),
    "timescales": lambda s, d: feat.timescales(v.daily_curve(s, d)),
}


def functions() -> dict[str, tuple[str, str, str]]:
    """{name: (parameters, type, body)} of every SQL function."""
    out = {
        "finite": ("x DOUBLE", "DOUBLE", "CASE WHEN NOT isnan(x) AND abs(x) <> double('infinity') THEN x END"),
        "flux_to_mag": (f"flux DOUBLE, zero_point DOUBLE DEFAULT {ZP_MICRO}D", "DOUBLE", "CASE WHEN flux > 0 THEN -2.5D * log10(flux) + zero_point END"),
        "flux_to_mag_err": ("flux DOUBLE, err DOUBLE", "DOUBLE", f"CASE WHEN flux > 0 THEN {POGSON}D * err / flux END"),
        "log_normal_cdf": ("x DOUBLE", "DOUBLE", log_normal_cdf_sql("x")),
        "is_positive": ("x STRING", "BOOLEAN", "lower(x) IN ('t', 'true', '1')"),
        "blank_to_null": ("x STRING", "STRING", "CASE WHEN trim(x) <> '' THEN x END"),
    }
    for m in M.CLOSED_FORM:
        body = m.evaluate(M.SqlOps, [M.Sql(p) for p in m.params], M.Sql("t"))
        out[f"flux_{m.name.lower()}"] = ("t DOUBLE, " + ", ".join(f"{p} DOUBLE" for p in m.params), "DOUBLE", str(body))
    return out


def install(spark: SparkSession, sf_dir: str) -> None:
    """Make the views of ``sf_dir`` and the functions in this session; earlier ones of the same names are replaced."""
    for name in TABLES:
        v.table(spark, sf_dir, name).createOrReplaceTempView(name)
    for view in CURVES:
        view(spark, sf_dir).createOrReplaceTempView(view.__name__)
    for name, result in RESULTS.items():
        result(spark, sf_dir).createOrReplaceTempView(name)
    for name, (parameters, kind, body) in functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")


#: Each object's band against two models at fixed parameters: how many points, the mean magnitude of the peak, and both mean squared residuals.
MODELS_TEXT = """
SELECT object, band, count(*) AS n,
  round(min(flux_to_mag(peak)), 6) AS peak_mag,
  round(avg(power(y - flux_bazin(t, 0, 0, 3, ln(2), ln(20), -3), 2)), 6) AS bazin,
  round(avg(power(y - flux_arnett(t, 0, 3, ln(10), 0, -3), 2)), 6) AS arnett,
  round(sum(CASE WHEN is_upper THEN log_normal_cdf((ceiling - y) / greatest(s, 1e-3D)) ELSE 0 END), 5) AS limits
FROM events_relative GROUP BY object, band
"""
#: Parts by brand: flags of their alerts beside the parts' own columns.
ALERTS_TEXT = """
SELECT p.p_brand, count(*) AS n, count_if(f.rock) AS rocks, count_if(f.star) AS stars, count_if(f.near_brightstar) AS bright,
  round(avg(flux_to_mag(p.p_retailprice, 31.4)), 6) AS mag
FROM alert_flags f JOIN part p USING (p_partkey) GROUP BY p.p_brand
"""
#: Objects whose curve rises in some band: a view of rates joined with one of time scales.
RATES_TEXT = """
SELECT r.object, count(*) AS n_bands, round(min(x.peak_mag), 5) AS peak_mag, round(any_value(t.t_peak), 6) AS t_peak
FROM band_extremes x JOIN band_rates r USING (object, band) JOIN timescales t ON t.object = r.object
GROUP BY r.object HAVING count(*) > 1
"""


def query(text: str):
    def run(spark: SparkSession, sf_dir: str):
        install(spark, sf_dir)
        return spark.sql(text)

    return run


def queries() -> dict:
    return {"sql_models": query(MODELS_TEXT), "sql_alerts": query(ALERTS_TEXT), "sql_rates": query(RATES_TEXT)}
