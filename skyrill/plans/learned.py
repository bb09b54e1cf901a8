"""Queries over learned models, folds and draws, and over the SQL interface, with twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import normal, normal_sql
from ..operators import boosting, embedding, isolation, ml
from ..sources.scratch import staged
from . import sqltext
from . import views as v
from .catalog import _round

COLUMNS = [f"f{i}" for i in range(v.N_FEATURES)]


def _imputed(spark, sf_dir) -> DataFrame:
    return staged(ml.impute_median(v.features(spark, sf_dir), COLUMNS, 0.0), "imputed")


def _boosted(spark, sf_dir, settings=boosting.Settings()) -> tuple[boosting.Boosted, DataFrame]:
    """The model of the training share, and all rows."""
    rows = staged(ml.stratified_split(_imputed(spark, sf_dir), "vec_id", "class"), "split")
    return boosting.fit(rows.where("train"), COLUMNS, "class", settings), rows


def boosted_trees(spark, sf_dir):
    """Class probabilities of every vector by a booster of the usual settings, fitted on the training share."""
    model, rows = _boosted(spark, sf_dir)
    told = model.probabilities(rows, "vec_id", "class", "train")
    return told.select("vec_id", "class", "train", "prediction", *[F.round(F.col("probabilities")[k], 6).alias(f"p_{c}") for k, c in enumerate(model.classes)])


def boosted_accuracy(spark, sf_dir):
    """Accuracy after twenty rounds on training rows and on the others, and the number of splits that the model uses."""
    model, rows = _boosted(spark, sf_dir, boosting.Settings(rounds=20))
    n = F.count(F.lit(1))
    correct = F.count(F.when(F.col("prediction") == F.col("class"), 1))
    splits = model.importance(spark).agg(F.sum("splits").alias("n_splits"))
    return model.probabilities(rows, "class", "train").groupBy("train").agg(n.alias("n"), correct.alias("correct"), (correct / n).alias("accuracy")).crossJoin(F.broadcast(splits))


def neighbour_embedding(spark, sf_dir):
    """Two coordinates of every vector by its nearest neighbours."""
    return embedding.embed(_imputed(spark, sf_dir), "vec_id", COLUMNS)


def isolation_outliers(spark, sf_dir):
    """Isolation scores of every vector in its embedding; the top two in a hundred are outliers."""
    return isolation.outliers(staged(neighbour_embedding(spark, sf_dir), "embedded"), "vec_id", ["u", "v"])


def stratified_folds(spark, sf_dir):
    return ml.stratified_folds(v.features(spark, sf_dir).select("vec_id", "class"), "vec_id", "class", ml.FOLDS)


def classifier_search(spark, sf_dir):
    """Accuracy of each of the 16 combinations on each of three stratified folds of the training share."""
    rows = ml.stratified_split(_imputed(spark, sf_dir), "vec_id", "class").where("train")
    data = ml.stratified_folds(ml.assemble(rows, COLUMNS, "class").select("vec_id", "x", "y"), "vec_id", "y", ml.FOLDS)
    return ml.search_table(staged(data, "dealt")).withColumn("accuracy", F.col("correct") / F.col("n"))


def normal_draws(spark, sf_dir):
    """Two independent normal numbers for each event, and a flux moved by its error."""
    e = v.events_curve(spark, sf_dir)
    z = [normal(F.col("pos"), 42, k) for k in (0, 1)]
    return _round(e.select("pos", z[0].alias("z0"), z[1].alias("z1"), (F.col("flux") + F.col("err") * z[0]).alias("flux")), 8)


def queries() -> dict:
    q = [boosted_trees, boosted_accuracy, neighbour_embedding, isolation_outliers, stratified_folds, classifier_search, normal_draws]
    return {f.__name__: f for f in q} | sqltext.queries()


def oracle_sql() -> dict:
    from . import oracles as o

    r = o._r
    bazin = "exp(-(t - 3) / exp(ln(20))) / (1 + exp(-(t - 3) / exp(ln(2))))"
    return {
        "stratified_folds": f"WITH {v.FEAT} SELECT vec_id, class, ((row_number() OVER (PARTITION BY class ORDER BY md5(vec_id || ':{ml.SEED}'), vec_id) - 1) % {ml.FOLDS})::INT AS fold FROM ft",
        "normal_draws": f"WITH {v.EV} SELECT pos, {r(normal_sql('pos', 42, 0), 8)} AS z0, {r(normal_sql('pos', 42, 1), 8)} AS z1, {r(f'flux + err * {normal_sql("pos", 42, 0)}', 8)} AS flux FROM ev",
        "sql_models": f"WITH {v.REL}, p AS (SELECT *, {o._flux(o.M.MODELS['Arnett'], (0, 3, 'ln(10)', 0, -3))} AS arnett, {bazin} AS bazin FROM rel) SELECT object, band, count(*) AS n, round(-2.5 * log10(max(peak)) + 23.9, 6) AS peak_mag, round(avg((y - bazin) ^ 2), 6) AS bazin, round(avg((y - arnett) ^ 2), 6) AS arnett, round(sum(CASE WHEN is_upper THEN {o.log_normal_cdf_sql('(ceiling - y) / greatest(s, 1e-3)')} ELSE 0 END), 5) AS limits FROM p GROUP BY object, band",
        "sql_alerts": f"WITH f AS ({o.ORACLES['alert_flags']}) SELECT p_brand, count(*) AS n, count(*) FILTER (rock) AS rocks, count(*) FILTER (star) AS stars, count(*) FILTER (near_brightstar) AS bright, round(avg(-2.5 * log10(p_retailprice) + 31.4), 6) AS mag FROM f JOIN part USING (p_partkey) GROUP BY p_brand",
        "sql_rates": f"WITH {v.DAILY}, x AS (SELECT object, band, min(mag) AS m FROM mg GROUP BY ALL), p AS (SELECT object, first(t ORDER BY m, k) AS t FROM ix GROUP BY object) SELECT object, count(*) AS n_bands, round(min(m), 5) AS peak_mag, round(any_value(p.t), 6) AS t_peak FROM x JOIN p USING (object) GROUP BY object HAVING count(*) > 1",
    }
