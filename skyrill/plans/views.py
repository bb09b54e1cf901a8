"""Light curves and feature tables derived from the standard tables, for queries and for their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import flux_to_mag, flux_to_mag_err, time_to_mjd

BAND_OF = {"click": "g", "view": "r", "purchase": "i", "signup": "z", "error": "y"}
#: All elements of an embedding.
N_FEATURES = 64
#: Modular recipe of alert columns from a part key: factor, modulus, scale, shift.
FLAG_RECIPE = {
    "sgscore1": (7, 101, 0.01, 0.0),
    "sgscore2": (11, 101, 0.01, 0.0),
    "sgscore3": (13, 101, 0.01, 0.0),
    "distpsnr1": (5, 31, 0.1, 0.0),
    "distpsnr2": (3, 41, 1.0, 0.0),
    "distpsnr3": (9, 41, 1.0, 0.0),
    "srmag1": (17, 23, 0.5, 10.0),
    "srmag2": (19, 23, 0.5, 10.0),
    "srmag3": (21, 23, 0.5, 10.0),
    "sgmag1": (15, 19, 0.5, 12.0),
    "simag1": (8, 29, 0.5, 8.0),
    "szmag1": (6, 29, 0.5, 8.0),
    "ssdistnr": (4, 37, 1.0, -2.0),
    "ssmagnr": (2, 27, 1.0, -3.0),
    "neargaiabright": (12, 53, 1.0, 0.0),
    "maggaiabright": (14, 33, 0.5, 2.0),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as objects, event types as bands, values as fluxes."""
    e = table(spark, sf_dir, "events")
    band = F.create_map(*[F.lit(x) for kv in BAND_OF.items() for x in kv])[F.col("event_type")]
    return e.select(F.col("user_id").alias("object"), band.alias("band"), time_to_mjd(F.col("ts")).alias("mjd"), F.col("value").alias("flux"), (F.col("value") * 0.02 * (1 + F.col("event_id") % 7)).alias("err"), F.col("event_id").alias("pos"))


def events_mags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_curve(spark, sf_dir).where("flux > 0")
    return e.withColumns({"mag": flux_to_mag(F.col("flux")), "mag_err": flux_to_mag_err(F.col("flux"), F.col("err"))})


def events_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time since the first point of the object's band; normalised flux, errors and limits."""
    from pyspark.sql import Window

    from ..operators.prep import normalize

    n = normalize(events_curve(spark, sf_dir))
    return n.withColumn("t", F.col("mjd") - F.min("mjd").over(Window.partitionBy("object", "band")))


def items_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as objects, return flags as bands, prices as fluxes: many years with repeated epochs."""
    i = table(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_suppkey").alias("object"),
        F.col("l_returnflag").alias("band"),
        time_to_mjd(F.col("l_shipdate")).alias("mjd"),
        F.col("l_extendedprice").alias("flux"),
        (F.col("l_quantity") + 0.1 * F.col("l_linenumber")).alias("err"),
        F.struct("l_orderkey", "l_linenumber").alias("pos"),
    )


def daily_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean magnitude of each object and day."""
    m = events_mags(spark, sf_dir)
    return m.groupBy("object", F.floor("mjd").cast("double").alias("t")).agg(F.round(F.avg("mag"), 6).alias("m"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert columns made from part keys, with nulls."""
    p = table(spark, sf_dir, "part")
    cols = []
    for k, (name, (a, m, s, b)) in enumerate(FLAG_RECIPE.items()):
        value = (F.col("p_partkey") * a % m) * F.lit(s) + b
        cols.append(F.when((F.col("p_partkey") + k) % 11 != 0, value.cast("float")).alias(name))
    return p.select("p_partkey", *cols)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as features with holes; the label as class."""
    e = table(spark, sf_dir, "embeddings")
    cols = [F.when((F.col("vec_id") + i) % 13 != 0, F.col("embedding")[i].cast("double")).alias(f"f{i}") for i in range(N_FEATURES)]
    return e.select("vec_id", F.col("label").cast("string").alias("class"), *cols)


_BANDS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BAND_OF.items()) + " END"
EV = f"ev AS (SELECT user_id AS object, {_BANDS_SQL} AS band, 40587 + epoch_us(ts) / 86400e6 AS mjd, value AS flux, value * 0.02 * (1 + event_id % 7) AS err, event_id AS pos FROM events)"
MG = EV + ", mg AS (SELECT *, -2.5 * log10(flux) + 23.9 AS mag, 1.0857 * err / flux AS mag_err FROM ev WHERE flux > 0)"
REL = (
    EV
    + ", pk AS (SELECT *, max(flux) OVER (PARTITION BY object, band) AS peak FROM ev), rel AS (SELECT object, band, mjd, flux, err, peak, pos, flux / peak AS y, err / peak AS s, (err > 0 AND flux / err < 3.0) AS is_upper, 3.0 * err / peak AS ceiling, mjd - min(mjd) OVER (PARTITION BY object, band) AS t FROM pk WHERE peak > 0)"
)
IT = "it AS (SELECT l_suppkey AS object, l_returnflag AS band, 40587 + epoch_us(l_shipdate) / 86400e6 AS mjd, l_extendedprice AS flux, l_quantity + 0.1 * l_linenumber AS err, l_orderkey AS p1, l_linenumber AS p2 FROM lineitem)"
DAILY = MG + ", daily AS (SELECT object, floor(mjd)::DOUBLE AS t, round(avg(mag), 6) AS m FROM mg GROUP BY ALL), ix AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY object) AS n FROM daily)"
FLAGS = "al AS (SELECT p_partkey, " + ", ".join(f"CASE WHEN (p_partkey + {k}) % 11 <> 0 THEN ((p_partkey * {a} % {m}) * {s}::DOUBLE + {b})::FLOAT END AS {name}" for k, (name, (a, m, s, b)) in enumerate(FLAG_RECIPE.items())) + " FROM part)"
FEAT = "ft AS (SELECT vec_id, label::VARCHAR AS class, " + ", ".join(f"CASE WHEN (vec_id + {i}) % 13 <> 0 THEN embedding[{i + 1}]::DOUBLE END AS f{i}" for i in range(N_FEATURES)) + " FROM embeddings)"
