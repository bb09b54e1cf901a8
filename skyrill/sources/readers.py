"""Readers: alert documents, both light-curve dialects, bundles, catalogues and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import ZP_MICRO, ZP_NANO
from .schemas import ALERT, BUNDLE, DEFAULTED
from .scratch import staged

MICRO = "mjd double, flux double, flux_err double, filter string"
NON_FEATURES = ("object", "band", "method", "variant", "model", "classification")


#: The object of a curve file: its name without the ending.
STEM = r"([^/]+)\.csv$"


def is_positive(x: Column) -> Column:
    """The boolean behind the text of t, true or 1 in any case; null stays null."""
    return F.lower(x).isin("t", "true", "1")


def blank_to_null(x: Column) -> Column:
    """Null for a text of blanks only; others are not trimmed."""
    return F.when(F.trim(x) != "", x)


def points(array: Column) -> Column:
    """Points with aliases resolved; an array that is absent is empty."""
    return F.coalesce(
        F.transform(array, lambda p: F.struct(F.coalesce(p["time"], p["jd"]).alias("time"), F.coalesce(p["mag"], p["magpsf"]).alias("mag"), F.coalesce(p["mag_err"], p["sigmapsf"]).alias("mag_err"), p["band"].alias("band"))),
        F.array().cast("array<struct<time: double, mag: float, mag_err: float, band: string>>"),
    )


def normalise_alerts(raw: DataFrame) -> DataFrame:
    """Coerce flags, fill defaults and resolve aliases of alert documents."""
    c = F.col("candidate")
    filled = c
    for names in DEFAULTED.values():
        for n in names.split():
            filled = filled.withField(n, F.coalesce(c[n], F.lit(0)))
    filled = filled.withField("isdiffpos", is_positive(c["isdiffpos"])).withField("ssnamenr", blank_to_null(c["ssnamenr"]))
    return raw.select("_id", "objectId", filled.alias("candidate"), points(F.col("prv_candidates")).alias("prv_candidates"), points(F.col("fp_hists")).alias("fp_hists"))


def read_alerts(spark: SparkSession, path: str, mode: str = "FAILFAST", names: str = "*.json") -> DataFrame:
    """One document for each file of ``names``; FAILFAST ends on a bad one, PERMISSIVE gives it null fields."""
    raw = spark.read.schema(ALERT).option("multiLine", True).option("mode", mode).option("pathGlobFilter", names).json(path)
    return normalise_alerts(raw)


def route_alerts(spark: SparkSession, path: str, names: str = "*.json", lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good documents as they are (for ``normalise_alerts`` or the enrichment), and (file, text) of those that are no JSON or do not fit the schema.

    A document is a file, or with ``lines`` a line, so that files follow the size of the alerts and not their number.
    Files are read once. A document without an id or without a candidate is bad, too.
    """
    schema = T.StructType([*ALERT.fields, T.StructField("_bad", T.StringType())])
    raw = spark.read.schema(schema).option("multiLine", not lines).option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", names).json(path)
    # Written once: both sides read it, and the corrupt column alone could not be asked for in the files.
    both = staged(raw.select(F.col("_metadata.file_path").alias("file"), "*"), "alerts")
    bad = F.col("_bad").isNotNull() | F.col("_id").isNull() | F.col("candidate").isNull()
    names_of = [f.name for f in ALERT.fields]
    text = F.coalesce("_bad", F.to_json(F.struct(*names_of)))
    return both.where(~bad).select(*names_of), both.where(bad).select("file", text.alias("text"))


def object_name() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), STEM, 1)


def read_micro(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Microjansky curves (positional mjd, flux, flux_err, filter), named by file; a bad number fails, a short line goes."""
    text = spark.read.schema("c0 string, c1 string, c2 string, c3 string").option("header", True).option("enforceSchema", True).option("pathGlobFilter", "*.csv").csv(paths)
    full = text.withColumn("object", object_name()).where("c3 is not null")
    return full.select("object", F.col("c3").alias("band"), F.col("c0").cast("double").alias("mjd"), F.col("c1").cast("double").alias("flux"), F.col("c2").cast("double").alias("err"), F.monotonically_increasing_id().alias("pos"), F.lit(ZP_MICRO).alias("zero_point"))


def read_nano(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Nanojansky curves (by column name; mjd and band needed); a row of bad mjd goes, other bad cells are null."""
    raw = spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(paths)
    raw = raw.withColumn("object", object_name())
    known = {c.lower(): c for c in raw.columns}
    number = lambda *names: F.coalesce(*[F.col(known[n]).try_cast("double") for n in names if n in known], F.lit(None).cast("double"))
    out = raw.select("object", F.col("band"), number("expmidptmjd").alias("mjd"), number("mag").alias("mag"), number("magerr").alias("magerr"), number("flux_corrected", "psfdiffflux").alias("flux"), number("flux_corrected_err", "psfdifffluxerr").alias("err"))
    return out.where("mjd is not null").withColumns({"pos": F.monotonically_increasing_id(), "zero_point": F.lit(ZP_NANO)})


def _curve_files(spark: SparkSession, paths: str | list[str], recursive: bool = False, packed: bool = False) -> DataFrame:
    """(file, header, text) of the CSV files among ``paths``, files and folders alike (with ``recursive`` folders in them, too).

    A file is the curve of one object, so it is one row: its lines and its header need no shuffle to meet.
    With ``packed`` the files lie in packs (``writers.write_curves``), and a pack's path is in front of a file's own.
    """
    found = spark.read.option("recursiveFileLookup", recursive)
    if packed:
        files = found.option("pathGlobFilter", "*.json").schema("path string, text string").json(paths)
        files = files.select(F.concat("_metadata.file_path", F.lit("/"), "path").alias("file"), F.col("text").alias("value"))
    else:
        files = found.option("pathGlobFilter", "*.csv").text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", F.rtrim(F.substring_index("value", "\n", 1)).alias("header"), F.col("value").alias("text")).where("text <> ''")


def _is_nano(header: Column) -> Column:
    return header.startswith("night,band,") | header.contains("expMidptMJD")


def detect_formats(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, dialect, zero_point) by each file's first line."""
    nano = _is_nano(F.col("header"))
    return _curve_files(spark, path).select("file", F.when(nano, "nano").otherwise("micro").alias("dialect"), F.when(nano, ZP_NANO).otherwise(ZP_MICRO).alias("zero_point"))


def read_curves(spark: SparkSession, paths: str | list[str], recursive: bool = False, name: str = STEM, packed: bool = False) -> dict[str, DataFrame]:
    """Curves by dialect of any mix of files and folders; each file is parsed by its own header, in its own task, and named by the pattern ``name`` of its path.

    Files may be ``packed``: some thousand small ones in one. Fields hold no commas. Both dialects follow the rules of ``read_micro`` and ``read_nano``; ``pos`` is the line's number in its file.
    """
    lines = F.posexplode(F.split("text", "\r?\n")).alias("pos", "value")
    rows = _curve_files(spark, paths, recursive, packed).select("file", "header", lines).where("pos > 0 and value <> ''")
    rows = rows.select(F.regexp_extract("file", name, 1).alias("object"), "pos", F.split("value", ",", -1).alias("f"), F.split("header", ",", -1).alias("h"), _is_nano(F.col("header")).alias("nano"))
    micro = rows.where(~F.col("nano") & (F.size("f") >= 4)).select("object", F.col("f")[3].alias("band"), *[F.col("f")[k].cast("double").alias(n) for k, n in enumerate(("mjd", "flux", "err"))], "pos", F.lit(ZP_MICRO).alias("zero_point"))
    lower = F.transform("h", lambda x: F.lower(F.trim(x)))
    cell = lambda n: F.try_element_at("f", F.nullif(F.array_position(lower, n).cast("int"), F.lit(0)))
    number = lambda *names: F.coalesce(*[cell(n).try_cast("double") for n in names])
    values = {"mjd": ("expmidptmjd",), "mag": ("mag",), "magerr": ("magerr",), "flux": ("flux_corrected", "psfdiffflux"), "err": ("flux_corrected_err", "psfdifffluxerr")}
    nano = rows.where("nano").select("object", cell("band").alias("band"), *[number(*n).alias(c) for c, n in values.items()], "pos", F.lit(ZP_NANO).alias("zero_point"))
    return {"micro": micro, "nano": nano.where("mjd is not null")}


def explode_bundle(rows: DataFrame, column: str = "bundle") -> tuple[DataFrame, DataFrame]:
    """Catalogue (object, classification, probability) and photometry (object, mjd, flux, err, band) of JSON bundles."""
    entries = rows.select(F.explode(F.from_json(F.col(column), BUNDLE)).alias("object", "e"))
    catalogue = entries.select("object", "e.classification", "e.probability")
    p = entries.select("object", F.explode("e.photometry").alias("p"))
    number = lambda k: F.try_element_at("p", F.lit(k)).try_cast("double")
    return catalogue, p.select("object", number(1).alias("mjd"), number(2).alias("flux"), number(3).alias("err"), F.try_element_at("p", F.lit(4)).alias("band"))


def sanitize(rows: DataFrame, column: str, key: str) -> DataFrame:
    """Arrays of JSON objects without the elements that lack ``key``; a key whose value is null counts as present."""
    parsed = F.from_json(F.col(column), "array<map<string,string>>")
    return rows.withColumn(column, F.to_json(F.filter(parsed, lambda e: F.map_contains_key(e, key))))


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """Class of each object: trimmed, the last line of an object wins, lines of fewer than two fields go."""
    lines = spark.read.option("header", True).schema("object string, classification string, probability string").csv(path)
    lines = lines.where("classification is not null").withColumn("line", F.monotonically_increasing_id())
    g = lines.groupBy(F.trim("object").alias("object")).agg(F.max(F.struct("line", F.trim("classification").alias("c"))).alias("x"))
    return g.select("object", F.col("x.c").alias("classification"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature table: every column outside ``NON_FEATURES`` is a number, bad cells are null."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(c) if c in NON_FEATURES else F.col(c).try_cast("double").alias(c) for c in raw.columns])


def read_parameters(spark: SparkSession, path: str, prefix: str = "sim_") -> DataFrame:
    """(object, band, model, params) of a long parameter table, params a map from name to mean and deviation."""
    rows = spark.read.option("header", True).csv(path).where(F.col("object").startswith(prefix))
    entry = F.struct("param", F.struct(F.col("svi_mean").try_cast("double").alias("mean"), F.col("svi_std").try_cast("double").alias("std")))
    return rows.groupBy("object", "band", "model").agg(F.map_from_entries(F.collect_list(entry)).alias("params"), F.first(F.col("mag_chi2").try_cast("double")).alias("chi2"))
