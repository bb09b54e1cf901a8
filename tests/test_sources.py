"""Readers, sinks, flags with missing values, and the stream."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skyrill.operators.flags import alert_flags
from skyrill.operators import photometry
from skyrill.plans import formats, views
from skyrill.sources import readers, writers
from skyrill.streaming import enrich

SF = "/root/testdata/sf0.001"


@pytest.fixture
def alert_dir(tmp_path):
    point = {"jd": 1.0, "magpsf": 18.0, "sigmapsf": 0.1, "band": "g"}
    for k, flag in enumerate(["t", "1", "FALSE", True]):
        doc = {"_id": k, "objectId": f"o{k}", "candidate": {"isdiffpos": flag, "ssnamenr": "  " if k else " x ", "srmag1": None, "programid": 1}, "prv_candidates": [point, {"time": 2.0, "mag": 17.0, "mag_err": 0.1, "band": "r"}], "fp_hists": []}
        (tmp_path / f"{k}.json").write_text(json.dumps(doc, indent=1))
    return str(tmp_path)


def test_alert_documents(spark, alert_dir):
    rows = {r["_id"]: r for r in readers.read_alerts(spark, alert_dir).collect()}
    assert [rows[k]["candidate"]["isdiffpos"] for k in range(4)] == [True, True, False, True]
    assert rows[0]["candidate"]["ssnamenr"] == " x " and rows[1]["candidate"]["ssnamenr"] is None
    assert rows[0]["candidate"]["ra"] == 0 and rows[0]["candidate"]["srmag1"] is None
    assert rows[0]["prv_candidates"][0]["mag"] == 18.0 and rows[0]["prv_candidates"][1]["time"] == 2.0


def test_stream_equals_batch(spark, alert_dir, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")
    enrich.start(spark, alert_dir, f"{out}/sink", f"{out}/check").awaitTermination()
    got = spark.read.parquet(f"{out}/sink").orderBy("_id").collect()
    from skyrill.sources.schemas import ALERT

    want = enrich.enrich(spark.read.schema(ALERT).option("multiLine", True).json(alert_dir)).orderBy("_id").collect()
    assert got == want and got[0]["peak_band"] == "r" and got[0]["stationary"]


def test_curve_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("mjd,flux,flux_err,filter\n1.0,2.0,0.1,g\n2.0,3.0\n3.0,-1.0,0.2,r\n")
    (tmp_path / "b.csv").write_text("night,band,expMidptMJD,mag,magerr,flux_corrected,flux_corrected_err,fluxlim,magLim\n1,g,5.5,20,0.1,x,1,0,0\n1,g,bad,20,0.1,1,1,0,0\n")
    (tmp_path / "c.txt").write_text("mjd,flux,flux_err,filter\n9.0,9.0,9.0,z\n")
    curves = readers.read_curves(spark, str(tmp_path))
    mixed = readers.read_curves(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"])
    assert all(curves[k].drop("pos").exceptAll(mixed[k].drop("pos")).count() == 0 and mixed[k].count() == curves[k].count() for k in curves)
    assert readers.read_micro(spark, f"{tmp_path}/a.csv").drop("pos").exceptAll(curves["micro"].drop("pos")).count() == 0
    assert {(r.file.rsplit("/", 1)[1], r.dialect) for r in readers.detect_formats(spark, str(tmp_path)).collect()} == {("a.csv", "micro"), ("b.csv", "nano")}
    assert {(r.object, r.band, r.flux) for r in curves["micro"].collect()} == {("a", "g", 2.0), ("a", "r", -1.0)}
    (b,) = curves["nano"].collect()
    assert (b.object, b.mjd, b.flux, b.zero_point) == ("b", 5.5, None, 31.4)


def test_packed_curves(spark, tmp_path):
    """Packs give what a folder of files for each object gives, in few files."""
    e = views.events_curve(spark, SF).select(F.col("object").alias("o"), "mjd", "flux", F.col("err").alias("flux_err"), F.col("band").alias("filter"))
    nano = e.select("o", F.floor("mjd").alias("night"), F.col("filter").alias("band"), F.col("mjd").alias("expMidptMJD"), F.when(F.col("flux") > 50, F.col("flux")).alias("mag"), F.lit(0.5).alias("magerr"), F.col("flux").alias("psfDiffFlux"), F.col("flux_err").alias("psfDiffFluxErr"))
    parts = {"micro": e.where("o % 2 = 0"), "nano": nano.where("o % 2 = 1")}
    for name, part in parts.items():
        writers.write_curves(part, "o", str(tmp_path / "packs" / name))
        part.repartition("o").write.partitionBy("o").option("header", True).csv(str(tmp_path / "files" / name))
    packs, files = (readers.read_curves(spark, str(tmp_path / d), recursive=True, name=r"o=([^/]+)/[^/]+\.csv$", packed=d == "packs") for d in ("packs", "files"))
    for name, part in parts.items():
        # Lines of a curve have no order; their numbers are a curve's own.
        assert packs[name].drop("pos").exceptAll(files[name].drop("pos")).count() == 0 and packs[name].count() == files[name].count() == part.count() > 0
        assert packs[name].select("object", "pos").exceptAll(files[name].select("object", "pos")).count() == 0
    n = e.select("o").distinct().count()
    assert len(list((tmp_path / "packs").rglob("*.json"))) < n / 2 and len(list((tmp_path / "files").rglob("*.csv"))) >= n


def test_flags_with_missing_values(spark):
    cols = list(views.FLAG_RECIPE)
    base = dict.fromkeys(cols)
    cases = [
        ({"ssdistnr": 3.0}, (True, False, False)),
        ({}, (False, False, False)),
        ({"sgscore1": 0.5, "distpsnr1": 0.5, "simag1": 15.0}, (False, True, False)),
        ({"sgscore1": 0.5, "distpsnr1": 0.4, "simag1": 16.0}, (False, True, True)),
        ({"sgscore1": 0.3, "distpsnr1": 0.5}, (False, False, False)),
        ({"neargaiabright": 5.0, "maggaiabright": 11.0}, (False, False, True)),
        ({"sgscore1": 0.2, "distpsnr1": 0.5, "szmag1": 10.0, "srmag1": 14.0}, (False, False, False)),
    ]
    df = spark.createDataFrame([tuple((base | c)[k] for k in cols) + (i,) for i, (c, _) in enumerate(cases)], ", ".join(f"{c} float" for c in cols) + ", i int")
    got = [(r.rock, r.star, r.near_brightstar) for r in alert_flags(df).orderBy("i").collect()]
    assert got == [w for _, w in cases]


def test_last_class_wins(spark, tmp_path):
    (tmp_path / "c.csv").write_text("object,classification,probability\na, SN ,1\nb\na,TDE,1\n")
    assert [tuple(r) for r in readers.read_classes(spark, str(tmp_path / "c.csv")).collect()] == [("a", "TDE")]


def test_missing_values_are_written_as_nan(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456, None)], "object string, x double, y double")
    writers.write_features(df, str(tmp_path / "f"))
    (r,) = spark.read.option("header", True).csv(str(tmp_path / "f")).collect()
    assert (r.x, r.y) == ("1.235", "NaN")
    assert readers.read_features(spark, str(tmp_path / "f")).select(F.col("y").isNull() | F.isnan("y")).first()[0]


def test_sanitize_keeps_present_nulls(spark):
    df = spark.createDataFrame([('[{"magpsf":null,"jd":1},{"jd":2}]',)], "h string")
    assert json.loads(readers.sanitize(df, "h", "magpsf").first()[0])[0]["jd"] == "1"


def test_curves_in_a_row_equal_grouped_ones(spark):
    e = views.events_mags(spark, "/root/testdata/sf0.001").select("object", "band", F.col("mjd").alias("time"), "mag", "mag_err")
    rows = e.groupBy("object").agg(F.collect_list(F.struct("time", "mag", "mag_err", "band")).alias("curve")).withColumn("curve", photometry.clean_curve(F.col("curve"))).cache()
    points = rows.select("object", F.explode("curve").alias("p")).select("object", "p.band", F.col("p.time").alias("mjd"), "p.mag", "p.mag_err", F.col("p.k").alias("pos"))
    got = rows.select("object", F.explode(photometry.curve_bands(F.col("curve"))).alias("band", "of"))
    key = lambda r: (r.object, r.band)
    same = lambda x, y: x == y or x is not None and y is not None and abs(x - y) <= 1e-6 * max(abs(x), 1)
    rates = {key(r): r for r in photometry.band_rates(points).collect()}
    extremes = {key(r): r for r in photometry.band_extremes(points).collect()}
    of = {key(r): r.of for r in got.collect()}
    assert set(of) == set(rates) == set(extremes) and any(x.rise for x in of.values()) and any(x.fade for x in of.values())
    for k, x in of.items():
        assert (x.peak.time, x.peak.mag, x.faint.time, x.faint.mag, x.n_points) == (extremes[k].peak_mjd, extremes[k].peak_mag, extremes[k].faint_mjd, extremes[k].faint_mag, extremes[k].n_points)
        for name in ("rise", "fade"):
            line = x[name] or {"rate": None, "r2": None, "n": None}
            assert all(same(line[f], rates[k][f"{name}_{f}"]) for f in ("rate", "r2", "n")), (k, name)


def test_bad_alerts_are_routed(spark, alert_dir, tmp_path_factory):
    d = tmp_path_factory.mktemp("routed")
    for name in ("0", "1"):
        (d / f"{name}.json").write_text(open(f"{alert_dir}/{name}.json").read())
    (d / "cut.json").write_text('{"_id": 7, "objectId": "o7", "candidate": {"jd": 1.0')
    (d / "text.json").write_text("no document")
    (d / "empty_object.json").write_text("{}")
    (d / "number.json").write_text('{"_id": "seven", "objectId": "o8", "candidate": {}}')
    good, bad = readers.route_alerts(spark, str(d))
    assert {r["_id"] for r in good.collect()} == {0, 1}
    assert readers.normalise_alerts(good).exceptAll(readers.read_alerts(spark, alert_dir).where("_id < 2")).count() == 0
    found = {r.file.rsplit("/", 1)[1]: r.text for r in bad.collect()}
    assert set(found) == {"cut.json", "text.json", "empty_object.json", "number.json"} and '"o7"' in found["cut.json"]


def test_bad_alerts_are_routed_by_line(spark, alert_dir, tmp_path_factory):
    """Documents as lines of one file are told apart like documents in files."""
    whole = [json.dumps(json.loads(open(f"{alert_dir}/{n}.json").read())) for n in ("0", "1")]
    broken = ['{"_id": 7, "objectId": "o7", "candidate": {"jd": 1.0', "no document", "{}", '{"_id": "seven", "objectId": "o8", "candidate": {}}']
    d = tmp_path_factory.mktemp("lines")
    (d / "lines.json").write_text("\n".join([broken[0], whole[0], *broken[1:3], whole[1], broken[3]]) + "\n")
    good, bad = readers.route_alerts(spark, str(d), lines=True)
    assert readers.normalise_alerts(good).exceptAll(readers.read_alerts(spark, alert_dir).where("_id < 2")).count() == 0 and good.count() == 2
    texts = [r.text for r in bad.collect()]
    assert len(texts) == 4 and {broken[0], broken[1]} <= set(texts)


def test_alert_files_follow_size(spark):
    path = formats._alert_files(spark, SF).removeprefix("file://")
    files = list(Path(path).glob("part-*"))
    assert sum(len(f.read_text().splitlines()) for f in files) == formats._documents(spark, SF).count() > 2 * len(files)


def test_model_input_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 1.0, 5.0), ("b", 1, 2.0, 5.5), ("b", 1, 3.0, None)], "class string, k int, x double, y double")
    importance = spark.createDataFrame([("x", 0.5), ("y", 2.0)], "feature string, importance double")
    writers.write_model_inputs(rows, importance, ["x", "y"], "class", "k", str(tmp_path / "m"))
    read = lambda n: sorted(map(tuple, spark.read.option("header", True).csv(f"{tmp_path}/m/{n}").collect()), key=str)
    assert read("ml") == [("a", "0", "1.0", "5.0"), ("b", "1", "2.0", "5.5"), ("b", "1", "3.0", None)]
    assert read("feature_importance") == [("0", "0.5"), ("1", "2.0")] and read("class_stats") == [("a", "0", "1"), ("b", "1", "2")]


def test_parameter_tables(spark, tmp_path):
    row = ("sim_1", "g", "Bazin", "t0", 1.23456789, 2.0, None, 0.123456, float("nan"), 3.0)
    df = spark.createDataFrame([row], "object string, band string, model string, param string, pso_value double, svi_mean double, svi_std double, pso_chi2 double, svi_elbo double, mag_chi2 double")
    writers.write_all_parameters(df, str(tmp_path / "p"))
    (r,) = spark.read.option("header", True).csv(str(tmp_path / "p")).collect()
    assert tuple(r) == ("sim_1", "g", "Bazin", "t0", "1.234568", "2.000000", "NaN", "0.1235", "NaN", "3.0000")
    writers.write_summary(df.select("band", "pso_value", "svi_std"), ["band"], str(tmp_path / "s"))
    assert json.loads(next((tmp_path / "s").glob("part*")).read_text()) == {"band": "g", "summary": {"pso_value": 1.23456789, "svi_std": None}}


def test_parameter_files_follow_the_size_not_the_objects(spark, tmp_path):
    rows = [(f"sim_{o}", b, "Bazin", p, 1.0, float(o), 0.5, 0.1, -1.0, 2.0) for o in range(50) for b in "gr" for p in ("t0", "b")] + [("sim_ x ", "g", "Bazin", "b", 1.0, 7.0, 0.5, 0.1, -1.0, 2.0)]
    df = spark.createDataFrame(rows, "object string, band string, model string, param string, pso_value double, svi_mean double, svi_std double, pso_chi2 double, svi_elbo double, mag_chi2 double")
    writers.write_parameters(df, str(tmp_path / "table"))
    writers.write_parameters(df, str(tmp_path / "folders"), by_object=True)
    assert len(list((tmp_path / "table").rglob("*.csv"))) <= 4 and len(list((tmp_path / "folders").rglob("*.csv"))) == 51
    table, folders = (sorted((r.object, r.band, r.chi2, sorted((k, x.mean, x.std) for k, x in r.params.items())) for r in readers.read_parameters(spark, str(tmp_path / n)).collect()) for n in ("table", "folders"))
    assert len(table) == 101 and table == folders and table[0][0] == "sim_ x "
