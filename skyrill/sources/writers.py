"""Sinks: parameter and feature tables, model inputs, simulations and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Decimals of the columns of a GP feature table; others have three.
DECIMALS = {"n_obs": 0, "t0_days": 1, "gp_nugget": 6, "gp_alpha": 6, "gp_post_var_mean": 6, "gp_post_var_max": 6, "gp_n_inflections": 0}


#: Decimals of a parameter table: six for the parameters themselves, four for costs and qualities.
PARAMETER_DECIMALS = {"pso_value": 6, "svi_mean": 6, "svi_std": 6, "pso_chi2": 4, "svi_elbo": 4, "mag_chi2": 4}
#: Features that an importance table lists, and columns of a model input that are no features.
TOP_FEATURES = 20


def _fixed(rows: DataFrame, decimals: dict[str, int]) -> DataFrame:
    """Numbers as text with fixed decimals; a missing one is NaN, as other readers of these tables expect."""
    text = lambda c: F.coalesce(F.when(F.col(c).isNotNull() & ~F.isnan(c), F.format_string(f"%.{decimals[c]}f", F.col(c).cast("double"))), F.lit("NaN"))
    return rows.withColumns({c: text(c) for c in decimals if c in rows.columns})


def write_parameters(params: DataFrame, path: str, by_object: bool = False) -> None:
    """Long parameter table as CSV, an object's rows together in one file; ``by_object`` gives a folder for each object.

    Files follow the size of the table. A folder for each object costs some 10 ms on a local disk whatever it holds, so it is for few objects only.
    """
    rows = _fixed(params, PARAMETER_DECIMALS).repartition("object")
    if by_object:
        rows.write.mode("overwrite").partitionBy("object").option("header", True).csv(path)
    else:
        kept = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        rows.sortWithinPartitions("object", "band").write.mode("overwrite").options(**kept).csv(path)


def write_all_parameters(params: DataFrame, path: str) -> None:
    """The parameters of all objects as one CSV table with the object in front; parts are sorted by object and band."""
    names = ["object", *(c for c in params.columns if c != "object")]
    rows = _fixed(params.select(names), PARAMETER_DECIMALS)
    rows.repartitionByRange("object").sortWithinPartitions("object", "band", "param").write.mode("overwrite").option("header", True).csv(path)


def write_model_inputs(rows: DataFrame, importance: DataFrame, features: list[str], label: str, number: str, path: str) -> None:
    """The three tables of a classifier under ``path``: its input (class, its number, features by place), the most important features, and the classes.

    ``importance`` has (feature, importance) of all features.
    """
    named = [F.col(f).alias(f"feature_{k}") for k, f in enumerate(features)]
    rows.select(F.col(label).alias("classification"), F.col(number).alias("class_numeric"), *named).write.mode("overwrite").option("header", True).csv(f"{path}/ml")
    place = F.array_position(F.array(*map(F.lit, features)), F.col("feature")) - 1
    top = importance.select(place.alias("feature_index"), "importance").orderBy(F.desc("importance"), "feature_index").limit(TOP_FEATURES)
    top.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/feature_importance")
    classes = rows.groupBy(F.col(label).alias("class"), F.col(number).alias("class_numeric")).agg(F.count(F.lit(1)).alias("count"))
    classes.write.mode("overwrite").option("header", True).csv(f"{path}/class_stats")


def write_summary(rows: DataFrame, keys: list[str], path: str) -> None:
    """A summary as JSON: one object for each row, its ``keys`` in front and the other columns under ``summary``; missing values are null. Rows meet by key first, so no part is empty beside full ones."""
    rest = [c for c in rows.columns if c not in keys]
    rows.select(*keys, F.struct(*rest).alias("summary")).repartition(*keys).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_features(features: DataFrame, path: str) -> None:
    """Feature table as CSV with fixed decimals; missing values are written as NaN."""
    numbers = [c for c, t in features.dtypes if t == "double"]
    cells = {c: F.coalesce(F.when(F.col(c).isNotNull() & ~F.isnan(c), F.format_string(f"%.{DECIMALS.get(c, 3)}f", F.col(c))), F.lit("NaN")) for c in numbers}
    features.withColumns(cells).write.mode("overwrite").option("header", True).csv(path)


def write_curves(rows: DataFrame, key: str, path: str) -> None:
    """A CSV file with a header for each value of ``key``, in packs: lines of JSON (path, text).

    Packs follow the size of the table, where a file for each curve costs some milliseconds whatever it holds. A curve is one row, lines in no order.
    """
    names = [c for c in rows.columns if c != key]
    text = F.concat(F.lit(",".join(names) + "\n"), F.array_join(F.collect_list(F.to_csv(F.struct(*names))), "\n"), F.lit("\n"))
    files = rows.groupBy(key).agg(text.alias("text")).select(F.concat(F.lit(f"{key}="), F.col(key).cast("string"), F.lit("/curve.csv")).alias("path"), "text")
    files.write.mode("overwrite").json(path)


def write_table(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV with a header, JSON or Parquet."""
    rows.write.mode("overwrite").option("header", True).format(kind).save(path)


def report(rates: DataFrame) -> DataFrame:
    """One line of text for each object and band, bands in the order g, r, i, z, y, u."""
    order = F.array_position(F.array(*map(F.lit, "grizyu")), F.col("band"))
    line = F.format_string("%s %s: peak %.3f at %.5f, rise %s, fade %s", F.col("object").cast("string"), "band", "peak_mag", "peak_mjd", *[F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))).otherwise("-") for c in ("rise_rate", "fade_rate")])
    return rates.select("object", order.alias("k"), line.alias("line")).orderBy("object", "k").select("line")
