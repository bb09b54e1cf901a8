"""Named queries over the standard tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models as M
from ..functions.likelihood import log_normal_cdf
from ..functions.numeric import flux_to_mag, flux_to_mag_err
from ..operators import features as feat
from ..operators import fitters, ml, photometry, prep, selection, validate
from ..operators.flags import alert_flags
from ..sources.readers import explode_bundle, sanitize
from ..sources.scratch import staged
from ..sources.writers import report
from . import views as v

#: Fixed candidates of the deterministic model selection.
CANDIDATES = {m.name: tuple(0.0 if p == "log_a" else 3.0 if p == "t0" else m.start[i] for i, p in enumerate(m.params)) for m in M.MODELS.values()}
ORDER = list(M.MODELS)


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, missing ones null."""
    return df.select(*[(F.round(F.when(~F.isnan(c), F.col(c)), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _theta(model: M.Model) -> tuple[float, ...]:
    return CANDIDATES[model.name]


def model_flux(model: M.Model):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = v.events_relative(spark, sf_dir)
        return _round(rows.select("pos", model.evaluate(M.ColumnOps, _theta(model), F.col("t")).alias("flux")), 8)

    return query


def model_grad(model: M.Model):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = model.gradient(M.ColumnOps, _theta(model), F.col("t"))
        return _round(v.events_relative(spark, sf_dir).select("pos", *[d[p].alias(f"d_{p}") for p in model.params]), 7)

    return query


def _costs(spark, sf_dir):
    return selection.candidate_costs(v.events_relative(spark, sf_dir), CANDIDATES)


def _two_feature_sets(spark, sf_dir):
    e = v.events_mags(spark, sf_dir)
    a = e.groupBy("object", "band").agg(F.avg("mag").alias("x"))
    return a, e.groupBy("object", "band").agg(F.min("mag").alias("x"))


def _object_models(spark, sf_dir):
    best = selection.select_model(_costs(spark, sf_dir), ORDER)
    fits = best.withColumns({"class": F.element_at(F.array(*map(F.lit, validate.NATURAL)), (F.col("object") % 5 + 1).cast("int")), "chi2": F.col("cost")})
    return validate.object_model(fits)


def alert_band_peaks(spark, sf_dir):
    return _round(photometry.band_extremes(v.events_mags(spark, sf_dir)))


def alert_all_bands(spark, sf_dir):
    return _round(photometry.all_bands(v.events_mags(spark, sf_dir)))


def alert_rates(spark, sf_dir):
    return _round(photometry.band_rates(v.events_mags(spark, sf_dir)))


def alert_pivot(spark, sf_dir):
    return _round(photometry.pivot_bands(photometry.band_extremes(v.events_mags(spark, sf_dir)).select("object", "band", "peak_mag", "peak_mjd")))


def alert_flags_query(spark, sf_dir):
    return alert_flags(v.alerts(spark, sf_dir)).select("p_partkey", "rock", "star", "near_brightstar")


def merge_dedup(spark, sf_dir):
    m = v.events_mags(spark, sf_dir).select("object", "band", "mjd", "mag", "mag_err", "pos")
    return _round(photometry.merge_curves(m, m))


def flux_to_mag_query(spark, sf_dir):
    e = v.events_curve(spark, sf_dir)
    return _round(e.select("pos", flux_to_mag(F.col("flux")).alias("mag"), flux_to_mag(F.col("flux"), 31.4).alias("mag_nano"), flux_to_mag_err(F.col("flux"), F.col("err")).alias("mag_err")))


def njy_value_choice(spark, sf_dir):
    e = v.events_curve(spark, sf_dir)
    e = e.withColumns({"mag": F.when(F.col("pos") % 5 != 0, 20 + F.col("flux") / 100), "magerr": F.when(F.col("pos") % 3 == 0, -1.0).otherwise(F.col("err") / 100)})
    e = e.withColumn("flux", F.when(F.col("pos") % 4 == 0, -F.col("flux")).otherwise(F.col("flux")))
    return _round(prep.choose_value(e).select("pos", "value", "value_err", "origin"))


def prepare_obs(spark, sf_dir):
    return _round(prep.prepare(v.items_curve(spark, sf_dir)))


def prepare_obs_flux(spark, sf_dir):
    return _round(prep.prepare(v.items_curve(spark, sf_dir), to_mag=False))


def normalize_upper_limits(spark, sf_dir):
    return _round(v.events_relative(spark, sf_dir).select("pos", "y", "s", "is_upper", "ceiling", "t"), 8)


def reference_band(spark, sf_dir):
    return prep.reference_band(v.events_curve(spark, sf_dir))


def subsample25(spark, sf_dir):
    r = prep.subsample(v.items_curve(spark, sf_dir))
    return _round(r.select("object", "band", F.col("pos.l_orderkey").alias("l_orderkey"), F.col("pos.l_linenumber").alias("l_linenumber"), "mjd"))


def min_lengthscale(spark, sf_dir):
    return _round(prep.min_lengthscale(v.events_curve(spark, sf_dir)))


def noise_fraction(spark, sf_dir):
    return _round(prep.noise_fraction(v.events_curve(spark, sf_dir)))


def display_error(spark, sf_dir):
    e = v.events_curve(spark, sf_dir).withColumn("flux", F.when(F.col("pos") % 4 == 0, -F.col("flux")).otherwise(F.col("flux")))
    return _round(prep.display_error(e).select("pos", "mag_err"))


def rate_report(spark, sf_dir):
    return report(photometry.band_rates(v.events_mags(spark, sf_dir)))


def compare_parameters(spark, sf_dir):
    e = v.events_mags(spark, sf_dir)
    return _round(validate.compare_parameters(e.select(F.col("band").alias("param"), F.col("mag").alias("pso_value"), (F.col("mag") + F.col("mag_err")).alias("svi_mean"), F.col("mag_err").alias("svi_std"))))


def log_cdf(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    x = (F.col("value") - 100) / 10
    return _round(e.select("event_id", log_normal_cdf(x).alias("log_cdf")))


def pso_cost_grid(spark, sf_dir):
    return _round(_costs(spark, sf_dir), 3)


def model_select(spark, sf_dir):
    return _round(selection.select_model(_round(_costs(spark, sf_dir), 3), ORDER), 3)


def t0_profile_refine(spark, sf_dir):
    return _round(selection.profile_onset(v.events_relative(spark, sf_dir), M.MODELS["Bazin"], CANDIDATES["Bazin"]), 5)


def mag_chi2(spark, sf_dir):
    return _round(selection.mag_chi2(v.events_relative(spark, sf_dir), M.MODELS["Bazin"], CANDIDATES["Bazin"]), 4)


def baseline_chi2(spark, sf_dir):
    return _round(selection.baseline_chi2(v.events_mags(spark, sf_dir)), 5)


def grid_points(spark, sf_dir):
    spans = v.events_curve(spark, sf_dir).groupBy("object").agg(F.min("mjd").alias("t_min"), F.max("mjd").alias("t_max"))
    return _round(feat.grid(spans).select("object", F.col("k").cast("long").alias("k"), "t"))


def grid_timescales(spark, sf_dir):
    return _round(feat.timescales(v.daily_curve(spark, sf_dir)))


def grid_shape(spark, sf_dir):
    return _round(feat.shape(v.daily_curve(spark, sf_dir)))


def interp_at(spark, sf_dir):
    last = v.events_mags(spark, sf_dir).groupBy("object").agg(F.round(F.max("mjd"), 6).alias("t_last"))
    return _round(feat.local_derivatives(v.daily_curve(spark, sf_dir), last))


def borrowed_offset(spark, sf_dir):
    return _round(feat.borrowed_offsets(v.events_mags(spark, sf_dir), v.daily_curve(spark, sf_dir)))


def borrowed_curve(spark, sf_dir):
    return _round(feat.borrowed_curves(v.events_mags(spark, sf_dir), v.daily_curve(spark, sf_dir)), 5)


def temperature_curve(spark, sf_dir):
    d = v.daily_curve(spark, sf_dir)
    t, s = feat.temperature(F.col("m"), F.lit(0.1))
    return _round(d.select("object", "t", t.alias("temperature"), s.alias("sigma")), 4)


def temperature_features(spark, sf_dir):
    d = v.daily_curve(spark, sf_dir)
    return _round(feat.temperature_features(d.withColumn("m", F.round(feat.temperature(F.col("m"), F.lit(0.0))[0], 3))), 4)


def percentile_band(spark, sf_dir):
    e = v.events_curve(spark, sf_dir)
    return _round(feat.index_percentiles(e.withColumn("day", F.floor("mjd").cast("long")), ["band", "day"], "flux"))


def impute_median(spark, sf_dir):
    cols = [f"f{i}" for i in range(v.N_FEATURES)]
    return _round(ml.impute_median(v.features(spark, sf_dir), cols))


def variance_importance(spark, sf_dir):
    return _round(ml.variance_importance(v.features(spark, sf_dir), [f"f{i}" for i in range(v.N_FEATURES)], 10), 9)


def class_stats(spark, sf_dir):
    return ml.class_counts(v.features(spark, sf_dir), "class")


def label_encode(spark, sf_dir):
    f = ml.drop_rare(v.features(spark, sf_dir), "class")
    return ml.encode_labels(f, "class").select("vec_id", "class", F.col("class_numeric").cast("long").alias("class_numeric"))


def feature_summary(spark, sf_dir):
    f = v.features(spark, sf_dir)
    return _round(f.groupBy("class").agg(*[g(c).alias(f"{n}_{c}") for c in ("f0", "f1", "f2") for n, g in (("mean", F.avg), ("std", F.stddev_pop))]), 8)


def feature_pivot(spark, sf_dir):
    e = v.events_mags(spark, sf_dir).groupBy("object", "band").agg(F.min("mag").alias("peak"), F.count(F.lit(1)).alias("n"))
    return _round(ml.pivot_features(e, ["g", "r", "i", "z", "y"], ["peak", "n"]))


def join_classes(spark, sf_dir):
    e = v.events_mags(spark, sf_dir).groupBy("object", "band").agg(F.min("mag").alias("peak"))
    c = ml.last_class(v.table(spark, sf_dir, "labels").select((F.col("doc_id") % 200).cast("string").alias("object"), F.concat(F.lit(" q"), F.col("quality"), F.lit("t"), F.col("toxic"), F.lit(" ")).alias("classification"), F.col("doc_id").alias("line")))
    return _round(ml.join_classes(e, c.withColumn("object", F.col("object").cast("long"))))


def method_compare(spark, sf_dir):
    return _round(validate.compare_methods(*_two_feature_sets(spark, sf_dir), "x"), 5)


def ratio_hist(spark, sf_dir):
    a, b = _two_feature_sets(spark, sf_dir)
    j = a.join(b.withColumnRenamed("x", "z"), ["object", "band"]).where("z > 0 and x / (z + 1e-6) > 0")
    return validate.histogram(j.withColumn("r", F.round(F.log10(F.col("x") / (F.col("z") + 1e-6)), 7)), F.col("r"), 0.0, 0.25, 25)


def ratio_hist_auto(spark, sf_dir):
    a, b = _two_feature_sets(spark, sf_dir)
    j = a.join(b.withColumnRenamed("x", "z"), ["object", "band"]).where("z > 0 and x / (z + 1e-6) > 0")
    return _round(validate.histogram_auto(j, F.round(F.log10(F.col("x") / (F.col("z") + 1e-6)), 7)), 9)


def class_validation(spark, sf_dir):
    c = staged(_round(_costs(spark, sf_dir), 3).withColumnsRenamed({"model": "class", "cost": "chi2"}), "costs")
    return _round(validate.class_validation(c), 3)


def confusion(spark, sf_dir):
    return validate.confusion(_object_models(spark, sf_dir), ORDER)


def accuracy(spark, sf_dir):
    return _round(validate.accuracy(_object_models(spark, sf_dir), validate.NATURAL))


def key_intersection(spark, sf_dir):
    e = v.events_curve(spark, sf_dir)
    return e.where("flux > 50").select("object", "band").intersect(e.where("err < 5").select("object", "band"))


def throughput(spark, sf_dir):
    r = v.events_curve(spark, sf_dir).select("object", "band", (F.col("flux") / 1000).alias("fit_seconds"))
    return _round(validate.throughput(r, 10.0))


def sanitize_nested(spark, sf_dir):
    c = v.table(spark, sf_dir, "conversations")
    turn = F.map_concat(F.create_map(F.lit("jd"), F.col("turn").cast("string")), F.when(F.col("role") == "user", F.create_map(F.lit("magpsf"), F.length("text").cast("string"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    rows = c.groupBy("conv_id").agg(F.to_json(F.collect_list(turn)).alias("fp_hists"))
    kept = F.from_json("fp_hists", "array<map<string,string>>")
    return sanitize(rows, "fp_hists", "magpsf").select("conv_id", F.size(kept).cast("long").alias("n_kept"), F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x["magpsf"].cast("long")).alias("total"))


def explode_bundle_query(spark, sf_dir):
    e = v.events_curve(spark, sf_dir)
    obs = F.array(F.col("mjd").cast("string"), F.col("flux").cast("string"), F.col("err").cast("string"), F.col("band"))
    value = F.struct(F.lit("sn").alias("classification"), F.lit(0.5).alias("probability"), F.collect_list(obs).alias("photometry"))
    rows = e.groupBy("object").agg(value.alias("x")).select(F.to_json(F.create_map(F.col("object").cast("string"), F.col("x"))).alias("bundle"))
    _, points = explode_bundle(rows)
    return _round(points.groupBy("object", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("flux").alias("flux"), F.max("mjd").alias("last")), 4)


def gp_features(backend: str):
    def query(spark, sf_dir):
        # Times of magnitude observations start at the object's first one.
        return fitters.fit_gp(prep.prepare(v.events_curve(spark, sf_dir)), backend)

    return query


def svi_fit(spark, sf_dir):
    return fitters.fit_parametric(v.events_relative(spark, sf_dir))


def posterior_band(spark, sf_dir):
    rows = v.events_relative(spark, sf_dir)
    spans = rows.groupBy("object", "band").agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.first("peak").alias("peak"))
    return fitters.posterior_curves(fitters.fit_parametric(rows), spans)


def kilonova_curve(spark, sf_dir):
    spans = v.events_relative(spark, sf_dir).groupBy("object").agg(F.lit(-1.0).alias("t_min"), F.max("t").alias("t_max"))
    return _round(fitters.kilonova_curves(spans, (-2.0, -0.7, 0.5, 0.0)))


def kilonova_gradient(spark, sf_dir):
    spans = v.events_relative(spark, sf_dir).groupBy("object").agg(F.lit(-1.0).alias("t_min"), F.max("t").alias("t_max"))
    return _round(fitters.kilonova_gradients(spans, (-2.0, -0.7, 0.5, 0.0)), 3)


def simulate(spark, sf_dir):
    return validate.simulate(spark)


def simulated_truth(spark, sf_dir):
    return validate.simulated_truth(spark)


def train_classifier(spark, sf_dir):
    cols = [f"f{i}" for i in range(v.N_FEATURES)]
    return ml.train_classifier(staged(ml.impute_median(v.features(spark, sf_dir), cols, 0.0), "imputed"), "vec_id", cols, "class", search=True)


def classification_report(spark, sf_dir):
    return ml.classification_report(train_classifier(spark, sf_dir).where("not train"))


def outliers(spark, sf_dir):
    cols = [f"f{i}" for i in range(v.N_FEATURES)]
    points = ml.project(staged(ml.impute_median(v.features(spark, sf_dir), cols, 0.0), "imputed"), "vec_id", cols)
    return ml.outliers(staged(points, "points"), "vec_id", ["p1", "p2"])


def queries() -> dict:
    q = [
        alert_band_peaks, alert_all_bands, alert_rates, alert_pivot, merge_dedup, njy_value_choice, prepare_obs, prepare_obs_flux, normalize_upper_limits, reference_band,
        subsample25, min_lengthscale, noise_fraction, display_error, rate_report, compare_parameters, pso_cost_grid, model_select, t0_profile_refine, mag_chi2, baseline_chi2, grid_points, grid_timescales, grid_shape, interp_at,
        borrowed_offset, borrowed_curve, temperature_curve, temperature_features, percentile_band, impute_median, variance_importance, class_stats, label_encode, feature_summary, feature_pivot,
        join_classes, method_compare, ratio_hist, ratio_hist_auto, class_validation, confusion, accuracy, key_intersection, throughput, sanitize_nested, svi_fit, posterior_band, kilonova_curve, kilonova_gradient,
        simulate, simulated_truth, train_classifier, classification_report, outliers,
    ]
    out = {f.__name__: f for f in q}
    out |= {"alert_flags": alert_flags_query, "flux_to_mag": flux_to_mag_query, "log_normal_cdf": log_cdf, "explode_bundle": explode_bundle_query, "gp_features_a": gp_features("A"), "gp_features_b": gp_features("B")}
    for m in M.CLOSED_FORM:
        out |= {f"model_flux_{m.name.lower()}": model_flux(m), f"model_grad_{m.name.lower()}": model_grad(m)}
    from . import formats, learned

    return out | formats.queries() | learned.queries()


def oracle_sql() -> dict:
    from . import formats, learned
    from .oracles import ORACLES

    return ORACLES | formats.oracle_sql() | learned.oracle_sql()
