"""SQL twins of the catalogue's queries, in the dialect of DuckDB."""

from __future__ import annotations

import math

from ..functions import models as M
from ..functions.likelihood import VAR_FLOOR, log_normal_cdf_sql
from ..operators.validate import NATURAL
from . import views as v
from .catalog import CANDIDATES, ORDER


def _r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0::DOUBLE)"


def _flux(m: M.Model, theta=None, t: str = "t") -> str:
    values = [M.Sql(repr(float(x))) if not isinstance(x, str) else M.Sql(x) for x in (theta or CANDIDATES[m.name])]
    return str(m.evaluate(M.SqlOps, values, M.Sql(t)))


def _cost(m: M.Model) -> str:
    var = f"(s * s + {math.exp(2 * CANDIDATES[m.name][-1]) + VAR_FLOOR!r})"
    term = f"CASE WHEN is_upper THEN -{log_normal_cdf_sql(f'(ceiling - p) / sqrt({var})')} ELSE (p - y) * (p - y) / {var} + ln({var}) END"
    return f"SELECT object, band, '{m.name}' AS model, avg({term}) AS cost FROM (SELECT *, {_flux(m)} AS p FROM rel) GROUP BY ALL"


def _kilonova(keys: str, spans: str, thetas: list[tuple[float, ...]]) -> str:
    """CTEs (to follow WITH RECURSIVE) that end in nm (keys, id, t0, k, d, l, d1, l1): the light at grid point k and at the next, for each of ``thetas``.

    ``spans`` selects the keys and hi, the last time. Written from the equations in functions/kilonova.py, step by step in cgs units.
    """
    c = "2.998e10"
    rows = ", ".join(f"({i}, {10 ** m * 1.989e33!r}::DOUBLE, {10**x * 2.998e10!r}::DOUBLE, {10**q!r}::DOUBLE, {t0!r}::DOUBLE)" for i, (m, x, q, t0) in enumerate(thetas))
    w = f"PARTITION BY {keys}, id ORDER BY k"
    return f"""th(id, mass, v0, kappa, t0) AS (VALUES {rows}),
sp AS (SELECT * REPLACE (hi - t0 AS hi) FROM ({spans}), th),
gr AS (SELECT sp.*, k, 0.01 * exp(ln(hi * 1.05 / 0.01) * k / 199) AS d FROM sp, range(200) r(k) WHERE hi > 0.01),
src AS (SELECT *, d * 86400 AS s, (lead(d) OVER ({w}) - d) * 86400 AS ds, 0.8 * exp(-d * 86400 / 900) AS xn FROM gr),
ht AS (SELECT *, mass * (3.2e14 * xn + 2e18 * 0.36 * (exp(-0.56 * d) + ln(1 + 0.34 * pow(d, 0.74)) / (0.34 * pow(d, 0.74))) * pow(greatest(0.5 - atan((s - 1.3) / 0.11) / pi(), 1e-30), 1.3)) / 1e40 AS heat,
 3 * (0.4 * (0.8 - xn) + kappa * 0.2) * mass / (4 * pi() * {c} * s) AS delay FROM src),
st AS (SELECT {keys}, id, k, 0.5 * mass * v0 * v0 / 1e40 AS e, 0.5 * mass * v0 * v0 / 1e40 AS kin, v0 AS v, s * v0 AS r FROM ht WHERE k = 0
 UNION ALL SELECT {keys}, id, k + 1, abs(e + (heat - e * v / r - e / (delay / v + r / {c})) * ds), kin + e * v / r * ds,
  least(sqrt(2 * (kin + e * v / r * ds) * 1e40 / mass), {c}), r + least(sqrt(2 * (kin + e * v / r * ds) * 1e40 / mass), {c}) * ds FROM st JOIN ht USING ({keys}, id, k) WHERE k < 199),
lt AS (SELECT {keys}, id, t0, k, d, e / (delay / v + r / {c}) AS light FROM st JOIN ht USING ({keys}, id, k)),
nm AS (SELECT {keys}, id, t0, k, d, light / max(light) OVER (PARTITION BY {keys}, id) AS l, lead(d) OVER ({w}) AS d1, lead(light) OVER ({w}) / max(light) OVER (PARTITION BY {keys}, id) AS l1 FROM lt)"""


_KILONOVA_AT = "coalesce(CASE WHEN q.t - nm.t0 < d THEN l ELSE l + (l1 - l) * (q.t - nm.t0 - d) / (d1 - d) END, 0)"
_KILONOVA_ON = "q.t > nm.t0 AND ((q.t - nm.t0 >= d AND q.t - nm.t0 < d1) OR (k = 0 AND q.t - nm.t0 < d))"


def _kilonova_cost() -> str:
    theta = CANDIDATES["MetzgerKN"]
    var = f"(s * s + {math.exp(2 * theta[-1]) + VAR_FLOOR!r})"
    term = f"CASE WHEN is_upper THEN -{log_normal_cdf_sql(f'(ceiling - p) / sqrt({var})')} ELSE (p - y) * (p - y) / {var} + ln({var}) END"
    seen = f"SELECT q.*, {_KILONOVA_AT} AS p FROM rel q LEFT JOIN nm ON q.object = nm.object AND q.band = nm.band AND {_KILONOVA_ON}"
    return f"SELECT object, band, 'MetzgerKN' AS model, avg({term}) AS cost FROM ({seen}) GROUP BY ALL"


COSTS = _kilonova("object, band", "SELECT object, band, max(t) AS hi FROM rel GROUP BY ALL", [CANDIDATES["MetzgerKN"][:4]]) + ", costs AS (" + " UNION ALL ".join([*(_cost(m) for m in M.CLOSED_FORM), _kilonova_cost()]) + ")"
_RANK = "list_position([" + ", ".join(f"'{n}'" for n in ORDER) + "], model)"
BEST = f"best AS (SELECT object, band, first(model ORDER BY cost, {_RANK}) AS model, min(cost) AS cost FROM costs GROUP BY ALL)"
_CLASS = "list_extract([" + ", ".join(f"'{c}'" for c in NATURAL) + "], (object % 5 + 1)::INT)"
OBJ = f"obj AS (SELECT object, {_CLASS} AS class, first(model ORDER BY cost, band) AS model FROM best GROUP BY object)"


def _points(order: str, prefix: str, extra: str = "") -> str:
    cols = ["mjd", "mag", "mag_err", *([extra] if extra else [])]
    return ", ".join((_r(f"first({c} ORDER BY {order})") if c != "band" else f"first({c} ORDER BY {order})") + f" AS {prefix}_{c}" for c in cols)


LOW, HIGH = "mag, mjd, pos", "mag DESC, mjd, pos"


def _segment(name: str, op: str) -> str:
    inside = f"FILTER ((mjd, pos) {op} (pm, pp))"
    n = f"count(*) {inside}"
    span = f"max(mjd) {inside} - min(mjd) {inside}"
    low = f"first(mag + mag_err ORDER BY mag, mjd, pos) {inside}"
    high = f"first(mag - mag_err ORDER BY mag DESC, mjd, pos) {inside}"
    ok = f"{n} > 1 AND {span} > 0.01 AND NOT ({low} >= {high})"
    return ", ".join(
        f"CASE WHEN {ok} THEN {x} END AS {name}_{y}"
        for x, y in ((_r(f"regr_slope(mag, mjd - pm) {inside}"), "rate"), (_r(f"regr_r2(mag, mjd - pm) {inside}"), "r2"), (n, "n"))
    )


_PIVOT = ", ".join(f"max(CASE WHEN band = '{b}' THEN {c} END) AS {b}_{n}" for b in "grizyu" for c, n in (("pmag", "peak_mag"), ("pmjd", "peak_mjd")))

ORACLES = {
    "alert_band_peaks": f"WITH {v.MG} SELECT object, band, {_points(LOW, 'peak')}, {_points(HIGH, 'faint')}, count(*) AS n_points FROM mg GROUP BY object, band",
    "alert_all_bands": f"WITH {v.MG} SELECT object, {_points(LOW, 'peak', 'band')}, {_points(HIGH, 'faint', 'band')}, {_r('min(mjd)')} AS first_mjd, {_r('max(mjd)')} AS last_mjd, max(mjd) - min(mjd) > 0.01 AS stationary FROM mg GROUP BY object",
    "alert_rates": f"WITH {v.MG}, p AS (SELECT *, first(mjd) OVER w AS pm, first(pos) OVER w AS pp, first(mag) OVER w AS pmag FROM mg WINDOW w AS (PARTITION BY object, band ORDER BY mag, mjd, pos)) SELECT object, band, {_r('any_value(pm)')} AS peak_mjd, {_r('any_value(pmag)')} AS peak_mag, {_segment('rise', '<=')}, {_segment('fade', '>=')} FROM p GROUP BY object, band",
    "alert_pivot": f"WITH {v.MG}, p AS (SELECT object, band, {_r(f'first(mag ORDER BY {LOW})')} AS pmag, {_r(f'first(mjd ORDER BY {LOW})')} AS pmjd FROM mg GROUP BY object, band) SELECT object, {_PIVOT} FROM p GROUP BY object",
    "merge_dedup": f"WITH {v.MG}, b AS (SELECT object, band, mjd, mag, mag_err, pos, 0 AS origin FROM mg UNION ALL SELECT object, band, mjd, mag, mag_err, pos, 1 FROM mg), l AS (SELECT *, lag(mjd) OVER w AS pm, lag(band) OVER w AS pb FROM b WINDOW w AS (PARTITION BY object ORDER BY mjd, origin, pos)) SELECT object, band, {_r('mjd')} AS mjd, {_r('mag')} AS mag, {_r('mag_err')} AS mag_err, pos, origin FROM l WHERE NOT coalesce(pm = mjd AND pb = band, false)",
    "flux_to_mag": f"WITH {v.EV} SELECT pos, CASE WHEN flux > 0 THEN {_r('-2.5 * log10(flux) + 23.9')} END AS mag, CASE WHEN flux > 0 THEN {_r('-2.5 * log10(flux) + 31.4')} END AS mag_nano, CASE WHEN flux > 0 THEN {_r('1.0857 * err / flux')} END AS mag_err FROM ev",
    "njy_value_choice": f"WITH {v.EV}, n AS (SELECT pos, err, CASE WHEN pos % 5 <> 0 THEN 20 + flux / 100 END AS mag, CASE WHEN pos % 3 = 0 THEN -1.0 ELSE err / 100 END AS magerr, CASE WHEN pos % 4 = 0 THEN -flux ELSE flux END AS flux FROM ev), c AS (SELECT *, CASE WHEN magerr > 0 AND mag IS NOT NULL THEN 'mag' WHEN flux > 0 AND err > 0 THEN 'flux' END AS origin FROM n) SELECT pos, {_r("CASE origin WHEN 'mag' THEN mag ELSE -2.5 * log10(CASE WHEN flux > 0 THEN flux ELSE 1 END) + 31.4 END")} AS value, {_r("CASE origin WHEN 'mag' THEN magerr ELSE 1.0857 * err / flux END")} AS value_err, origin FROM c WHERE origin IS NOT NULL",
    "normalize_upper_limits": f"WITH {v.REL} SELECT pos, {_r('y', 8)} AS y, {_r('s', 8)} AS s, is_upper, {_r('ceiling', 8)} AS ceiling, {_r('t', 8)} AS t FROM rel",
    "reference_band": f"WITH {v.EV}, c AS (SELECT object, band, count(*) AS n_points FROM ev GROUP BY ALL HAVING count(*) >= 5) SELECT *, row_number() OVER (PARTITION BY object ORDER BY n_points DESC, band) AS rank FROM c",
    "subsample25": f"WITH {v.IT}, r AS (SELECT *, count(*) OVER (PARTITION BY object, band) AS n, row_number() OVER (PARTITION BY object, band ORDER BY mjd, p1, p2) - 1 AS k FROM it) SELECT object, band, p1 AS l_orderkey, p2 AS l_linenumber, {_r('mjd')} AS mjd FROM r WHERE n <= 30 OR k IN (SELECT floor((i + 0.5) * n / 25.0)::BIGINT FROM range(25) g(i))",
    "min_lengthscale": f"WITH {v.EV}, s AS (SELECT object, band, mjd - lag(mjd) OVER (PARTITION BY object, band ORDER BY mjd, pos) AS step FROM ev), g AS (SELECT object, band, list_sort(list(step)) AS x FROM s WHERE step IS NOT NULL GROUP BY ALL) SELECT object, band, {_r('greatest(2 * x[len(x) // 2 + 1], 0.1)')} AS min_lengthscale, len(x) AS n_steps FROM g",
    "noise_fraction": f"WITH {v.EV} SELECT object, band, {_r('median(err / flux) FILTER (flux > 0)')} AS noise_fraction FROM ev GROUP BY ALL",
    "display_error": f"WITH {v.EV} SELECT pos, {_r('CASE WHEN pos % 4 <> 0 AND flux > 0 THEN 1.0857 * err / flux ELSE 0.1 END')} AS mag_err FROM ev",
    "compare_parameters": f"WITH {v.MG} SELECT band AS param, count(*) AS n, {_r('corr(mag, mag + mag_err)')} AS r, {_r('median((mag + mag_err) - mag)')} AS median_difference, {_r('median(mag_err)')} AS median_std FROM mg GROUP BY band",
    "log_normal_cdf": f"SELECT event_id, {_r(log_normal_cdf_sql('(value - 100) / 10'))} AS log_cdf FROM events",
    "pso_cost_grid": f"WITH RECURSIVE {v.REL}, {COSTS} SELECT object, band, model, {_r('cost', 3)} AS cost FROM costs",
    "model_select": f"WITH RECURSIVE {v.REL}, c0 AS (SELECT 1), {COSTS.replace('costs AS (', 'raw AS (')}, costs AS (SELECT object, band, model, {_r('cost', 3)} AS cost FROM raw), {BEST} SELECT * FROM best",
    "mag_chi2": f"WITH {v.REL}, p AS (SELECT *, {_flux(M.MODELS['Bazin'])} AS p FROM rel), q AS (SELECT object, band, CASE WHEN p > 0 AND y > 0 THEN (-2.5 * log10(CASE WHEN y > 0 THEN y ELSE 1 END) + 2.5 * log10(CASE WHEN p > 0 THEN p ELSE 1 END)) / (1.0857 * s / y) END AS r FROM p) SELECT object, band, {_r('avg(r * r)', 4)} AS mag_chi2, count(r) AS n_used FROM q GROUP BY ALL",
    "baseline_chi2": f"WITH {v.MG}, d AS (SELECT *, mag - avg(mag) OVER (PARTITION BY object, band) AS d FROM mg) SELECT object, band, {_r('avg(d * d / (mag_err * mag_err + 1e-10))', 5)} AS baseline_chi2, {_r('sqrt(avg(d * d))', 5)} AS rms FROM d GROUP BY ALL",
    "grid_points": f"WITH {v.EV}, s AS (SELECT object, min(mjd) AS lo, max(mjd) AS hi FROM ev GROUP BY ALL) SELECT object, k, {_r('lo + (hi - lo) * k / 49')} AS t FROM s, range(50) g(k)",
    "temperature_curve": f"WITH {v.DAILY}, c AS (SELECT object, t, least(greatest(15000.0 * pow(10.0, (18.0 - m) / 5), 3000.0), 50000.0) AS k FROM daily) SELECT object, t, {_r('k', 4)} AS temperature, {_r(f'least(k * {math.log(10) / 5!r} * 0.1, k * 0.8)', 4)} AS sigma FROM c",
    "percentile_band": f"WITH {v.EV}, g AS (SELECT band, floor(mjd)::BIGINT AS day, list_sort(list(flux)) AS x FROM ev GROUP BY ALL) SELECT band, day, {_r('x[floor(len(x) * 0.16)::INT + 1]')} AS p16, {_r('x[floor(len(x) * 0.5)::INT + 1]')} AS p50, {_r('x[floor(len(x) * 0.84)::INT + 1]')} AS p84 FROM g",
    "impute_median": f"WITH {v.FEAT}, m AS (SELECT {', '.join(f'median(f{i}) AS m{i}' for i in range(v.N_FEATURES))} FROM ft) SELECT vec_id, class, {', '.join(_r(f'coalesce(f{i}, m{i})') + f' AS f{i}' for i in range(v.N_FEATURES))} FROM ft, m",
    "variance_importance": f"WITH {v.FEAT}, u AS ({' UNION ALL '.join(f'SELECT {chr(39)}f{i}{chr(39)} AS feature, var_pop(f{i}) AS importance FROM ft' for i in range(v.N_FEATURES))}) SELECT feature, {_r('importance', 9)} AS importance FROM u ORDER BY importance DESC, feature LIMIT 10",
    "class_stats": f"WITH {v.FEAT} SELECT class, count(*) AS n FROM ft GROUP BY class",
    "label_encode": f"WITH {v.FEAT}, c AS (SELECT vec_id, class, count(*) OVER (PARTITION BY class) AS n FROM ft WHERE class IS NOT NULL) SELECT vec_id, class, dense_rank() OVER (ORDER BY class) - 1 AS class_numeric FROM c WHERE n >= 2",
    "feature_summary": f"WITH {v.FEAT} SELECT class, {', '.join(_r(f'{g}(f{i})', 8) + f' AS {n}_f{i}' for i in range(3) for n, g in (('mean', 'avg'), ('std', 'stddev_pop')))} FROM ft GROUP BY class",
    "feature_pivot": f"WITH {v.MG}, a AS (SELECT object, band, min(mag) AS peak, count(*) AS n FROM mg GROUP BY ALL) SELECT object, {', '.join(_r(f'max(CASE WHEN band = {chr(39)}{b}{chr(39)} THEN peak END)') + f' AS peak_{b}' for b in 'grizy')}, {', '.join(f'max(CASE WHEN band = {chr(39)}{b}{chr(39)} THEN n END) AS n_{b}' for b in 'grizy')} FROM a GROUP BY object",
    "join_classes": f"WITH {v.MG}, a AS (SELECT object, band, {_r('min(mag)')} AS peak FROM mg GROUP BY ALL), c AS (SELECT doc_id % 200 AS object, last('q' || quality || 't' || toxic ORDER BY doc_id) AS classification FROM labels GROUP BY ALL) SELECT a.*, classification FROM a JOIN c USING (object)",
    "method_compare": f"WITH {v.MG}, a AS (SELECT object, band, avg(mag) AS x, min(mag) AS y FROM mg GROUP BY ALL) SELECT band, count(*) AS n, CASE WHEN count(*) >= 3 THEN {_r('corr(x, y)', 5)} END AS r, {_r('median(y - x)', 5)} AS median_difference FROM a GROUP BY band",
    "ratio_hist": f"WITH {v.MG}, a AS (SELECT object, band, avg(mag) AS x, min(mag) AS z FROM mg GROUP BY ALL), r AS (SELECT round(log10(x / (z + 1e-6)), 7) AS r FROM a WHERE z > 0 AND x / (z + 1e-6) > 0) SELECT least(floor((r - 0.0) / ((0.25 - 0.0) / 25)), 24)::BIGINT AS bin, count(*) AS n FROM r WHERE r BETWEEN 0.0 AND 0.25 GROUP BY bin",
    "class_validation": f"WITH RECURSIVE {v.REL}, {COSTS}, c AS (SELECT model AS class, {_r('cost', 3)} AS chi2 FROM costs) SELECT class, count(*) AS n, {_r('median(chi2)', 3)} AS median_chi2, {_r('avg(chi2)', 3)} AS mean_chi2, {_r('100 * avg((chi2 < 1)::INT)', 3)} AS below_1, {_r('100 * avg((chi2 < 5)::INT)', 3)} AS below_5 FROM c GROUP BY ROLLUP (class)",
    "confusion": f"WITH RECURSIVE {v.REL}, {COSTS}, {BEST}, {OBJ} SELECT class, {', '.join(f'count(*) FILTER (model = {chr(39)}{n}{chr(39)}) AS {chr(34)}{n}{chr(34)}' for n in ORDER)} FROM obj GROUP BY class",
    "accuracy": f"WITH RECURSIVE {v.REL}, {COSTS}, {BEST}, {OBJ} SELECT class, count(*) AS n, {_r('avg(CASE WHEN ' + ' OR '.join(f'(class = {chr(39)}{c}{chr(39)} AND model IN (' + ', '.join(f'{chr(39)}{m}{chr(39)}' for m in ms) + '))' for c, ms in NATURAL.items()) + ' THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM obj GROUP BY ROLLUP (class)",
    "key_intersection": f"WITH {v.EV} SELECT object, band FROM ev WHERE flux > 50 INTERSECT SELECT object, band FROM ev WHERE err < 5",
    "throughput": f"WITH {v.EV} SELECT count(DISTINCT object) AS objects, count(*) AS bands, count(DISTINCT object) / 10.0 AS objects_per_s, count(*) / 10.0 AS bands_per_s, {_r('avg(flux / 1000)')} AS mean_fit_s FROM ev",
    "sanitize_nested": "SELECT conv_id, count(*) FILTER (role = 'user') AS n_kept, coalesce(sum(length(text)) FILTER (role = 'user'), 0)::BIGINT AS total FROM conversations GROUP BY conv_id",
    "explode_bundle": f"WITH {v.EV} SELECT object::VARCHAR AS object, band, count(*) AS n, {_r('sum(flux)', 4)} AS flux, {_r('max(mjd)', 4)} AS last FROM ev GROUP BY ALL",
}

_F = lambda x: f"{x}::FLOAT"
_INF = "'inf'::FLOAT"
_named = ", ".join(f"coalesce({n}, {'0::FLOAT' if n.startswith('sgscore') else _INF}) AS {n}" for n in v.FLAG_RECIPE)
_red = " OR ".join(f"({m} > 0 AND NOT isnan(srmag1 - {m}) AND srmag1 - {m} > {_F(3)})" for m in ("szmag1", "simag1"))
ORACLES["alert_flags"] = f"""WITH {v.FLAGS}, d AS (SELECT p_partkey, {_named} FROM al)
SELECT p_partkey, ssdistnr >= 0 AND ssdistnr < 12 AND ssmagnr >= 0 AS rock,
 (sgscore1 > {_F(0.76)} AND distpsnr1 BETWEEN 0 AND 2) OR (sgscore1 > {_F(0.2)} AND distpsnr1 BETWEEN 0 AND 1 AND srmag1 > 0 AND ({_red})) AS star,
 (neargaiabright BETWEEN 0 AND 20 AND maggaiabright > 0 AND maggaiabright <= 12)
 OR {' OR '.join(f'(sgscore{k} > {_F(0.49)} AND distpsnr{k} <= 20 AND srmag{k} > 0 AND srmag{k} <= 15)' for k in (1, 2, 3))}
 OR (sgscore1 = {_F(0.5)} AND distpsnr1 < {_F(0.5)} AND (sgmag1 < 17 OR srmag1 < 17 OR simag1 < 17)) AS near_brightstar FROM d"""


def _prepare(to_mag: bool) -> str:
    ok = "err > 0 AND flux > 0" if to_mag else "err > 0"
    value, error = ("-2.5 * log10(flux) + 23.9", "1.0857 * err / flux") if to_mag else ("flux", "err")
    return f"""WITH {v.IT}, st AS (SELECT *, min(mjd) OVER (PARTITION BY object) AS start FROM it),
dd AS (SELECT *, row_number() OVER (PARTITION BY object, band, greatest(0, round(mjd * 1e6))::BIGINT ORDER BY err, p1, p2) AS k FROM st WHERE {ok}),
u AS (SELECT * FROM dd WHERE k = 1), md AS (SELECT object, list_sort(list(mjd))[count(*) // 2 + 1] AS middle FROM u GROUP BY object)
SELECT object, band, {_r('mjd - start')} AS t, {_r('mjd')} AS mjd, {_r(value)} AS value, {_r(error)} AS value_err FROM u JOIN md USING (object) WHERE mjd >= middle - 50.0"""


ORACLES |= {"prepare_obs": _prepare(True), "prepare_obs_flux": _prepare(False)}

_E1, _E2 = 1 - math.exp(-1), math.exp(-1)
ORACLES["grid_timescales"] = f"""WITH {v.DAILY},
p AS (SELECT object, first(k ORDER BY m, k) AS pk, min(m) AS pm, first(t ORDER BY m, k) AS pt, any_value(n) AS n FROM ix GROUP BY object),
b AS (SELECT p.object, pk, pm, pt, p.n, CASE WHEN pk > 1 THEN avg(m) FILTER (k < least(pk, 3)) ELSE pm + 0.5 END AS rb,
  sum(m) FILTER (k > pk AND k <= least((pk + p.n) // 2, p.n - 1)) / greatest(least((pk + p.n) // 2, p.n - 1) - pk, 1) AS fb FROM ix JOIN p USING (object) GROUP BY p.object, pk, pm, pt, p.n)
SELECT object, {_r('pt')} AS t_peak, {_r('pm')} AS peak,
 {_r(f'pt - first(t ORDER BY abs(m - (rb + (pm - rb) * {_E1!r})), k) FILTER (k < pk)')} AS rise_time,
 {_r(f'first(t ORDER BY abs(m - (fb + (pm - fb) * {_E2!r})), k) FILTER (k > pk) - pt')} AS decay_time,
 {_r('min(t) FILTER (k > pk AND m >= pm + 0.75) - max(t) FILTER (k < pk AND m >= pm + 0.75)')} AS fwhm,
 {_r('regr_slope(m, t) FILTER (k < least(greatest(ceil(b.n * 0.25), 2), b.n - 1))')} AS rise_rate,
 {_r('regr_slope(m, t) FILTER (k >= b.n - least(greatest(ceil(b.n * 0.25), 2), b.n))')} AS decay_rate
FROM ix JOIN b USING (object) GROUP BY object, pt, pm, pk, rb, fb, b.n"""

ORACLES["grid_shape"] = f"""WITH {v.DAILY},
a AS (SELECT *, max(CASE WHEN k = 1 THEN t END) OVER o - max(CASE WHEN k = 0 THEN t END) OVER o AS dt, avg(m) OVER o AS mean FROM ix WINDOW o AS (PARTITION BY object)),
d AS (SELECT *, (lead(m) OVER w - m) / dt AS d1, (lead(m) OVER w - 2 * m + lag(m) OVER w) / (dt * dt) AS d2 FROM a WINDOW w AS (PARTITION BY object ORDER BY k)),
e AS (SELECT *, lead(d2) OVER (PARTITION BY object ORDER BY k) AS nx FROM d),
g AS (SELECT object, count(*) AS n, stddev_pop(m) AS sd, max(m) - min(m) AS pp, avg(pow(m - mean, 3)) AS m3, avg(pow(m - mean, 4)) AS m4, max(d1) AS dmax, min(d1) AS dmin,
 max(m) FILTER (k = n - 1) / min(m) AS frac, count(*) FILTER (abs(d2) > 1e-6 AND abs(nx) > 1e-6 AND sign(d2) <> sign(nx)) AS turns FROM e GROUP BY object)
SELECT object, {_r('sd', 6)} AS sigma_f, {_r('pp', 6)} AS peak_to_peak, CASE WHEN n > 3 AND sd > 1e-10 THEN {_r('m3 / pow(sd, 3)', 6)} END AS skew,
 CASE WHEN n > 3 AND sd > 1e-10 THEN {_r('m4 / pow(sd, 4) - 3', 6)} END AS kurt, {_r('dmax', 6)} AS dfdt_max, {_r('dmin', 6)} AS dfdt_min, {_r('frac', 6)} AS frac_of_peak,
 CASE WHEN n > 2 THEN turns END AS n_inflections FROM g"""

_LERP = """br AS (SELECT object, t, m, k, n, lead(t) OVER w AS t1, lead(m) OVER w AS m1 FROM ix WINDOW w AS (PARTITION BY object ORDER BY k)),
hit AS (SELECT q.*, CASE WHEN (k = 0 AND q < t) OR k = n - 1 THEN m ELSE m + (m1 - m) * (q - t) / (t1 - t) END AS value FROM wanted q JOIN br USING (object)
  WHERE (k = 0 AND q < t) OR (k = n - 1 AND q >= t) OR (q >= t AND q < t1))"""
_AT = lambda s: f"max(value) FILTER (step = {s})"
ORACLES["interp_at"] = f"""WITH {v.DAILY}, la AS (SELECT object, round(max(mjd), 6) AS t_last FROM mg GROUP BY object),
wanted AS (SELECT object, step, t_last + step AS q FROM la, (SELECT unnest([-1, 0, 1, 2, 3]) AS step)), {_LERP}
SELECT object, {_r(f'{_AT(0)} - {_AT(-1)}', 6)} AS dfdt_now, {_r(f'{_AT(1)} - {_AT(0)}', 6)} AS dfdt_next, {_r(f'{_AT(1)} - 2 * {_AT(0)} + {_AT(-1)}', 6)} AS d2fdt2_now,
 {_r(_AT(1), 6)} AS mag_1d, {_r(_AT(2), 6)} AS mag_2d, {_r(f'{_AT(3)} - {_AT(2)}', 6)} AS extrap_slope FROM hit GROUP BY object"""
_SPARSE = f"""WITH {v.DAILY}, sp AS (SELECT *, count(*) OVER (PARTITION BY object, band) AS np FROM mg), wanted AS (SELECT object, band, mag, mjd AS q FROM sp WHERE np < 5), {_LERP},
o AS (SELECT object, band, median(mag - value) AS "offset", count(*) AS n_points FROM hit GROUP BY ALL)"""
ORACLES["borrowed_offset"] = f"""{_SPARSE} SELECT object, band, {_r('"offset"')} AS "offset", n_points FROM o"""
ORACLES["borrowed_curve"] = f"""{_SPARSE} SELECT object, band, t, {_r('m + "offset"', 5)} AS m FROM daily JOIN o USING (object)"""
ORACLES["ratio_hist_auto"] = f"WITH {v.MG}, a AS (SELECT object, band, avg(mag) AS x, min(mag) AS z FROM mg GROUP BY ALL), r AS (SELECT round(log10(x / (z + 1e-6)), 7) AS r FROM a WHERE z > 0 AND x / (z + 1e-6) > 0), e AS (SELECT min(r) AS lo, max(r) AS hi, (max(r) - min(r)) / 25 AS w FROM r), c AS (SELECT least(floor((r - lo) / w), 24)::BIGINT AS bin, count(*) AS n FROM r, e GROUP BY 1) SELECT b.bin, {_r('lo + b.bin * w', 9)} AS low, {_r('lo + (b.bin + 1) * w', 9)} AS high, coalesce(n, 0) AS n FROM range(25) b(bin) CROSS JOIN e LEFT JOIN c ON b.bin = c.bin"
ORACLES["temperature_features"] = f"""WITH {v.DAILY}, tc AS (SELECT object, t, k, n, round(least(greatest(15000.0 * pow(10.0, (18.0 - m) / 5), 3000.0), 50000.0), 3) AS x FROM ix),
w AS (SELECT *, lag(x) OVER o AS b, lead(x) OVER o AS a, lag(t) OVER o AS tb FROM tc WINDOW o AS (PARTITION BY object ORDER BY k))
SELECT object, {_r('max(x)', 4)} AS t_peak, {_r('max(x) FILTER (k = n - 1)', 4)} AS t_now,
 {_r('CASE WHEN first(b ORDER BY x DESC, k DESC) IS NOT NULL THEN (list_extract(list(a ORDER BY x DESC, k DESC), 1) - list_extract(list(b ORDER BY x DESC, k DESC), 1)) / (2 * (max(t) FILTER (k = 1) - max(t) FILTER (k = 0))) END', 4)} AS slope_peak,
 {_r('max((x - b) / (t - tb)) FILTER (k = n - 1)', 4)} AS slope_now FROM w GROUP BY object"""

_B = M.MODELS["Bazin"]
_TH = CANDIDATES["Bazin"]
_SHAPE = _flux(_B, ["0.0", "0.0", "onset", *(repr(float(x)) for x in _TH[3:])])
ORACLES["t0_profile_refine"] = f"""WITH {v.REL},
bd AS (SELECT object, band, min(t) - 30.0 AS lo, first(t ORDER BY y DESC, t) + 5.0 AS hi FROM rel GROUP BY ALL),
g AS (SELECT rel.*, k, lo + (hi - lo) * k / 49 AS onset, s * s + {VAR_FLOOR + math.exp(2 * _TH[-1])!r} AS var FROM rel JOIN bd USING (object, band), range(50) r(k)),
f0 AS (SELECT *, {_SHAPE} AS fr FROM g), f AS (SELECT *, CASE WHEN NOT isnan(fr) AND NOT isinf(fr) THEN fr END AS f FROM f0),
sm AS (SELECT object, band, k, coalesce(sum(1 / var) FILTER (NOT is_upper AND f IS NOT NULL), 0) AS w1, coalesce(sum(f / var) FILTER (NOT is_upper), 0) AS wf, coalesce(sum(f * f / var) FILTER (NOT is_upper), 0) AS wff,
 coalesce(sum(y / var) FILTER (NOT is_upper AND f IS NOT NULL), 0) AS wy, coalesce(sum(f * y / var) FILTER (NOT is_upper), 0) AS wfy FROM f GROUP BY ALL),
dt AS (SELECT *, CASE WHEN abs(wff * w1 - wf * wf) > 1e-20 THEN wff * w1 - wf * wf END AS det FROM sm),
ab AS (SELECT object, band, k, coalesce((wfy * w1 - wf * wy) / det > 1e-10, false) AS ok, (wfy * w1 - wf * wy) / det AS a, (wff * wy - wf * wfy) / det AS b FROM dt),
sc AS (SELECT f.object, f.band, f.k, onset, is_upper, y, ceiling, var, CASE WHEN ok THEN a ELSE {math.exp(_TH[0])!r} END * f + CASE WHEN ok THEN b ELSE {_TH[1]!r} END AS p FROM f JOIN ab USING (object, band, k)),
ll AS (SELECT object, band, k, any_value(onset) AS onset, sum(CASE WHEN is_upper THEN {log_normal_cdf_sql('(ceiling - p) / sqrt(var)')} ELSE -0.5 * ((p - y) * (p - y) / var + ln({2 * math.pi!r} * var)) END) AS ll FROM sc WHERE p IS NOT NULL GROUP BY ALL),
tp AS (SELECT *, max(ll) OVER (PARTITION BY object, band) AS best FROM ll)
SELECT object, band, {_r('first(onset ORDER BY ll DESC, k)', 5)} AS t0, {_r('max(ll)', 5)} AS log_likelihood,
 {_r('greatest((max(onset) FILTER (ll >= best - 0.5) - min(onset) FILTER (ll >= best - 0.5)) / 2, 0.01)', 5)} AS t0_sigma FROM tp GROUP BY ALL"""

for _m in M.CLOSED_FORM:
    ORACLES[f"model_flux_{_m.name.lower()}"] = f"WITH {v.REL} SELECT pos, {_r(_flux(_m), 8)} AS flux FROM rel"
    _d = _m.gradient(M.SqlOps, [M.Sql(repr(float(x))) for x in CANDIDATES[_m.name]], M.Sql("t"))
    ORACLES[f"model_grad_{_m.name.lower()}"] = f"WITH {v.REL} SELECT pos, {', '.join(_r(str(_d[p]), 7) + f' AS d_{p}' for p in _m.params)} FROM rel"

def _kilonova_query(thetas: list[tuple[float, ...]], columns: str) -> str:
    spans = "SELECT object, max(t) AS hi FROM rel GROUP BY object"
    grid = "SELECT object, id, -1 + (hi + 1) * j / 49 AS t FROM (" + spans + "), th, range(50) r(j)"
    seen = f"SELECT q.object::VARCHAR AS object, q.id, q.t, {_KILONOVA_AT} AS flux FROM ({grid}) q LEFT JOIN nm ON nm.object = q.object AND nm.id = q.id AND {_KILONOVA_ON}"
    return f"WITH RECURSIVE {v.REL}, {_kilonova('object', spans, thetas)}, f AS ({seen}) SELECT object, {_r('t')} AS t, {columns} FROM f GROUP BY object, t"


_KN = (-2.0, -0.7, 0.5, 0.0)
ORACLES["kilonova_curve"] = _kilonova_query([_KN], f"{_r('any_value(flux)')} AS flux")
_moved = [tuple(x + 1e-5 * (i == k) for i, x in enumerate(_KN)) for k in range(4)]
_at = lambda i: f"max(flux) FILTER (id = {i})"
ORACLES["kilonova_gradient"] = _kilonova_query([_KN, *_moved], ", ".join([f"{_r(_at(0), 3)} AS flux", *(f"{_r(f'({_at(k + 1)} - {_at(0)}) / 1e-5', 3)} AS d_{n}" for k, n in enumerate(M.MODELS["MetzgerKN"].params[:4]))])).replace("(round(t, 6) + 0::DOUBLE) AS t", "(round(t, 3) + 0::DOUBLE) AS t")

_LINE = "printf('%s %s: peak %.3f at %.5f, rise %s, fade %s', object::VARCHAR, band, peak_mag, peak_mjd, CASE WHEN rise_rate IS NULL THEN '-' ELSE printf('%.4f', rise_rate) END, CASE WHEN fade_rate IS NULL THEN '-' ELSE printf('%.4f', fade_rate) END)"
_RATES = ORACLES["alert_rates"].replace(", 6) + 0::DOUBLE)", ", 15) + 0::DOUBLE)")
ORACLES["rate_report"] = f"SELECT {_LINE} AS line FROM ({_RATES})"
