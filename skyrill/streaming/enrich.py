"""Alert enrichment as a stream: every alert carries its history, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.flags import alert_flags
from ..operators.photometry import MIN_SPAN, clean_curve, curve_bands
from ..sources.readers import normalise_alerts
from ..sources.schemas import ALERT


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(ALERT).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)


def enrich(alerts: DataFrame) -> DataFrame:
    """Flags, all-band extremes and per-band peaks and rates of each alert row from its own arrays; works on batches and streams alike.

    The current detection is not part of the curve unless the history holds it.
    """
    a = normalise_alerts(alerts).withColumn("curve", clean_curve(F.concat("prv_candidates", "fp_hists")))
    flat = alert_flags(a.select("_id", "objectId", "candidate.*", "curve"))
    entry = lambda sign: F.transform("curve", lambda p: F.struct((sign * p["mag"]).alias("mag"), p["time"].alias("time"), p["band"].alias("band")))
    best, faint = F.array_min(entry(1)), F.array_min(entry(-1))
    times = F.transform("curve", lambda p: p["time"])
    return flat.select(
        "_id",
        "objectId",
        "programid",
        "rock",
        "star",
        "near_brightstar",
        F.coalesce(F.array_max(times) - F.array_min(times) > MIN_SPAN, F.lit(False)).alias("stationary"),
        best["mag"].alias("peak_mag"),
        best["time"].alias("peak_jd"),
        best["band"].alias("peak_band"),
        (-faint["mag"]).alias("faint_mag"),
        faint["time"].alias("faint_jd"),
        faint["band"].alias("faint_band"),
        F.array_min(times).alias("first_jd"),
        F.array_max(times).alias("last_jd"),
        F.size("curve").alias("n_points"),
        curve_bands(F.col("curve")).alias("bands"),
    )


def start(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Enrich new alert files as they arrive and append them as Parquet."""
    return enrich(read_stream(spark, source)).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
