"""Feature tables for classification: imputation, importance, labels, pivots, models, projection and outliers."""

from __future__ import annotations

import itertools
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import PCA, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..sources.scratch import scratch_path, staged
from .quantile import column_quantiles

SEED = 42


def impute_median(rows: DataFrame, features: list[str], fill: float | None = None) -> DataFrame:
    """Non-finite features replaced by the exact median of finite ones (``fill`` if a column has none).

    The medians are found at once, some numbers for each feature; the result is a projection of ``rows``.
    """
    medians = column_quantiles(rows.select(*[finite(F.col(c)).alias(c) for c in features]), features)
    known = {c: fill if m is None else m for c, m in medians.items()}
    return rows.withColumns({c: finite(F.col(c)) if known[c] is None else F.coalesce(finite(F.col(c)), F.lit(known[c])) for c in features})


def variance_importance(rows: DataFrame, features: list[str], top: int = 20) -> DataFrame:
    """The ``top`` features of largest population variance, ties by name."""
    wide = rows.agg(*[F.var_pop(c).alias(c) for c in features])
    long = wide.unpivot([], features, "feature", "importance")
    return long.orderBy(F.desc("importance"), "feature").limit(top)


def encode_labels(rows: DataFrame, label: str) -> DataFrame:
    """Alphabetical rank of each label from 0, by joining the few distinct labels back."""
    classes = rows.select(label).where(F.col(label).isNotNull()).distinct()
    ranked = classes.withColumn("class_numeric", F.dense_rank().over(Window.orderBy(label)) - 1)
    return rows.join(ranked, label)


def drop_rare(rows: DataFrame, label: str, least: int = 2) -> DataFrame:
    """Rows whose class is known and has at least ``least`` rows."""
    sizes = rows.where(F.col(label).isNotNull()).groupBy(label).count().where(F.col("count") >= least).select(label)
    return rows.join(sizes, label)


def class_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def pivot_features(rows: DataFrame, bands: list[str], features: list[str]) -> DataFrame:
    """One row for each object with {feature}_{band} columns; a repeated (object, band) is an error."""
    once = rows.groupBy("object", "band").agg(*[F.first(f).alias(f) for f in features], F.count(F.lit(1)).alias("__n"))
    once = once.withColumn("__n", F.when(F.col("__n") > 1, F.raise_error("repeated object and band")).otherwise(F.col("__n")))
    cells = [F.max(F.when((F.col("band") == b) & (F.col("__n") == 1), F.col(f))).alias(f"{f}_{b}") for f in features for b in bands]
    return once.groupBy("object").agg(*cells)


def last_class(rows: DataFrame) -> DataFrame:
    """Class of each object from rows (object, classification, line): trimmed, the last line wins."""
    g = rows.groupBy(F.trim("object").alias("object")).agg(F.max(F.struct("line", F.trim("classification").alias("c"))).alias("x"))
    return g.select("object", F.col("x.c").alias("classification"))


def join_classes(features: DataFrame, classes: DataFrame) -> DataFrame:
    """Feature rows that have a class; the planner broadcasts the classes if they are small."""
    return features.join(classes, "object")


def assemble(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    indexed = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(rows).transform(rows)
    return VectorAssembler(inputCols=features, outputCol="x").transform(indexed)


def stratified_split(rows: DataFrame, key: str, label: str, train: float = 0.75) -> DataFrame:
    """Add ``train``: by a hash of the key about ``train`` of each class, without a sort; a class's row of least hash is always in it."""
    h = F.xxhash64(F.col(key), F.lit(SEED))
    least = rows.groupBy(label).agg(F.min(h).alias("__least")).withColumnRenamed(label, "__label")
    joined = rows.join(least, F.col(label).eqNullSafe(F.col("__label")))
    share = F.pmod(h, F.lit(10_000)) < int(train * 10_000)
    return joined.withColumn("train", share | (h == F.col("__least"))).drop("__label", "__least")


def stratified_folds(rows: DataFrame, key: str, label: str, folds: int, seed: int = SEED) -> DataFrame:
    """``rows`` with ``fold``, from 0: within each class rows are dealt in turn, by order of a hash of the key, so sizes differ by one at most.

    Rows are placed by ranges of (class, hash), a class of any size over many tasks, and counted on from the parts before.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    parts = rows.withColumn("__h", digest).repartitionByRange(label, "__h", key).withColumn("__part", F.spark_partition_id())
    parts = staged(parts, "folds")
    before = Window.partitionBy(label).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(label, "__part").count()
    base = sizes.select(F.col(label).alias("__label"), F.col("__part").alias("__p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    joined = parts.join(base, (F.col("__part") == F.col("__p")) & F.col(label).eqNullSafe(F.col("__label")))
    place = F.col("__base") + F.row_number().over(Window.partitionBy("__part", label).orderBy("__h", key)) - 1
    return joined.withColumn("fold", (place % folds).cast("int")).drop("__h", "__part", "__p", "__label", "__base")


#: Fixed values of the search: two of each of four settings, as for boosted trees, here those of a forest.
GRID = {"maxDepth": [6, 8], "numTrees": [20, 40], "subsamplingRate": [0.7, 1.0], "minInstancesPerNode": [1, 4]}
FOLDS = 3


#: Settings that a fitted forest also holds at every lower value: its first trees are a forest, and so are its trees down to a depth.
NESTED = ("maxDepth", "numTrees")


@dataclass
class Tree:
    """Nodes by id: a row goes left if its feature is at most the threshold. Leaves have no sons (-1); ``votes`` are the shares of the classes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    votes: np.ndarray

    def down_to(self, depth: int) -> Tree:
        """The tree as it is when grown no deeper: nodes at ``depth`` are leaves, and two leaves that say the same are one, as Spark prunes them."""
        left, right, said = self.left.copy(), self.right.copy(), self.votes.argmax(axis=1)
        level = np.zeros(len(left), int)
        for k in range(len(left)):  # Sons come after their parent.
            if left[k] >= 0:
                level[[left[k], right[k]]] = level[k] + 1
        left[level >= depth] = -1
        for k in reversed(range(len(left))):
            if left[k] >= 0 and left[left[k]] < 0 and left[right[k]] < 0 and said[left[k]] == said[right[k]]:
                left[k] = -1
        return Tree(self.feature, self.threshold, left, right, self.votes)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), int), np.arange(len(x))
        while (inner := self.left[at] >= 0).any():
            son = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(inner, son, at)
        return at


def forest_trees(model: RandomForestClassificationModel, spark: SparkSession) -> list[Tree]:
    """The trees of a model from its saved nodes, as many as its settings allow whatever the rows."""
    path = scratch_path(spark, "forest")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").toPandas()
    trees = []
    for _, n in nodes.sort_values(["treeID", "id"]).groupby("treeID"):
        stats = np.stack(n["impurityStats"])
        split = list(n["split"])
        threshold = np.array([s["leftCategoriesOrThreshold"][0] if len(s["leftCategoriesOrThreshold"]) else 0.0 for s in split])
        votes = stats / np.maximum(stats.sum(axis=1, keepdims=True), np.finfo(float).tiny)
        trees.append(Tree(np.array([s["featureIndex"] for s in split]), threshold, n["leftChild"].to_numpy(), n["rightChild"].to_numpy(), votes))
    return trees


def nested_correct(rows: DataFrame, trees: list[Tree], settings: list[dict]) -> list[tuple[int, int]]:
    """(n, correct) over ``rows`` (x, y) of the forest within ``trees`` that each of the ``settings`` (of ``NESTED``) describes, in one scan."""
    depths = sorted({s.get("maxDepth", 0) for s in settings})
    grown = {d: [t.down_to(d) if d else t for t in trees] for d in depths}

    def run(batches):
        for batch in batches:
            x, y = np.stack(batch["x"]), batch["y"].to_numpy()
            for d in depths:
                votes = np.zeros((len(x), trees[0].votes.shape[1]))
                for k, t in enumerate(grown[d], 1):
                    votes += t.votes[t.leaves(x)]
                    for i, s in enumerate(settings):
                        if s.get("maxDepth", 0) == d and s.get("numTrees", len(trees)) == k:
                            yield pd.DataFrame({"i": [i], "n": [len(x)], "correct": [int((votes.argmax(axis=1) == y).sum())]})

    told = rows.select(vector_to_array("x").alias("x"), "y").mapInPandas(run, "i int, n long, correct long")
    found = {r.i: (r.n, r.correct) for r in told.groupBy("i").agg(F.sum("n").alias("n"), F.sum("correct").alias("correct")).collect()}
    return [found.get(i, (0, 0)) for i in range(len(settings))]


def search_table(fit: DataFrame) -> DataFrame:
    """(settings..., fold, n, correct): how each combination of the ``GRID`` does on each fold of ``fit`` (x, y, fold) when fitted on the others.

    Combinations that differ in depth or number of trees only are one fit, of the largest: its first trees, down to a depth, are the
    smaller forests. Several are fitted at once; what comes back is two counts for each combination.
    """
    names = list(GRID)
    nested = [n for n in names if n in NESTED]
    other = [n for n in names if n not in NESTED]
    largest = {n: max(GRID[n]) for n in nested}
    settings = [dict(zip(nested, values)) for values in itertools.product(*(GRID[n] for n in nested))]
    folds = sorted(r.fold for r in fit.select("fold").distinct().collect())
    spark = fit.sparkSession

    def one(job: tuple[int, tuple]) -> list[tuple]:
        fold, values = job
        fixed = dict(zip(other, values))
        model = RandomForestClassifier(featuresCol="x", labelCol="y", seed=SEED, **fixed, **largest).fit(fit.where(F.col("fold") != fold))
        counts = nested_correct(fit.where(F.col("fold") == fold), forest_trees(model, spark), settings)
        return [(*((fixed | s)[n] for n in names), fold, *c) for s, c in zip(settings, counts)]

    with ThreadPoolExecutor(8) as pool:
        found = [r for rows in pool.map(one, itertools.product(folds, itertools.product(*(GRID[n] for n in other)))) for r in rows]
    kinds = ["double" if isinstance(v[0], float) else "int" for v in GRID.values()]
    return spark.createDataFrame(found, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)) + ", fold int, n long, correct long")


def best_settings(table: DataFrame) -> dict:
    """The combination of highest mean accuracy over the folds, the first one of equals in order of the settings."""
    g = table.groupBy(*GRID).agg(F.avg(F.col("correct") / F.col("n")).alias("accuracy"))
    return g.orderBy(F.desc("accuracy"), *GRID).first().asDict()


def search_forest(fit: DataFrame, key: str) -> RandomForestClassificationModel:
    """The forest of the ``GRID`` (16 combinations) of best accuracy over stratified folds, fitted on all rows of ``fit``.

    As many folds as the smallest class has rows, ``FOLDS`` at most.
    """
    least = fit.groupBy("y").count().agg(F.min("count")).first()[0]
    dealt = stratified_folds(fit, key, "y", max(2, min(FOLDS, least)))
    best = best_settings(search_table(staged(dealt, "dealt")))
    return RandomForestClassifier(featuresCol="x", labelCol="y", seed=SEED, **{n: best[n] for n in GRID}).fit(fit)


def train_classifier(rows: DataFrame, key: str, features: list[str], label: str, search: bool = False, path: str | None = None) -> DataFrame:
    """Predictions (key, y, prediction, train) of a forest fitted on the training share.

    ``search`` cross-validates the grid over stratified folds; with ``path`` the model is saved there.
    """
    data = assemble(stratified_split(rows, key, label), features, label)
    fit = data.where("train")
    if search:
        model = search_forest(fit, key)
    else:
        model = RandomForestClassifier(featuresCol="x", labelCol="y", seed=SEED, numTrees=40, maxDepth=6).fit(fit)
    if path:
        model.write().overwrite().save(path)
    return model.transform(data).select(key, "y", "prediction", "train")


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class from one grouped count."""
    n = predictions.groupBy("y", "prediction").count()
    sides = n.select(F.col("y").alias("c"), "count", F.lit(1).alias("truth"), F.lit(0).alias("said"), (F.col("y") == F.col("prediction")).alias("hit")).union(n.select("prediction", "count", F.lit(0), F.lit(1), F.lit(False)))
    g = sides.groupBy("c").agg(F.sum(F.col("truth") * F.col("count")).alias("support"), F.sum(F.col("said") * F.col("count")).alias("said"), F.sum(F.when(F.col("hit"), F.col("count")).otherwise(0)).alias("hits"))
    p, r = F.col("hits") / F.nullif("said", F.lit(0)), F.col("hits") / F.nullif("support", F.lit(0))
    return g.select("c", p.alias("precision"), r.alias("recall"), (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"), "support")


def project(rows: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Two principal components of each row, in place of a neighbour embedding."""
    x = VectorAssembler(inputCols=features, outputCol="x").transform(rows)
    model = PCA(k=2, inputCol="x", outputCol="pc").fit(x)
    pc = vector_to_array("pc")
    return model.transform(x).select(key, pc[0].alias("p1"), pc[1].alias("p2"))


def outliers(points: DataFrame, key: str, columns: list[str], share: float = 0.02) -> DataFrame:
    """Rows whose largest robust distance (deviation over median absolute deviation) is among the top ``share``."""
    middle = column_quantiles(points, columns)
    away = points.select(key, *[F.abs(F.col(c) - F.lit(middle[c])).alias(c) for c in columns])
    spread = column_quantiles(away, columns)
    scored = away.select(key, F.greatest(F.lit(0.0), *[F.col(c) / F.lit(spread[c] or None) for c in columns]).alias("distance"))
    cut = column_quantiles(scored, ["distance"], 1 - share)["distance"]
    return scored.where(F.col("distance") >= F.lit(cut)).select(key, "distance")
