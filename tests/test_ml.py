from __future__ import annotations

import random

from pyspark.ml.classification import RandomForestClassificationModel

from skyrill.operators import ml


def test_search_and_saved_model(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    rows = [(i, k, rng.gauss(2 * (k == "a"), 1), rng.gauss(2 * (k == "b"), 1)) for i in range(240) for k in ["abc"[i % 3]]]
    df = spark.createDataFrame(rows, "id long, label string, x1 double, x2 double").cache()
    assert len(ml.GRID) == 4 and all(len(v) == 2 for v in ml.GRID.values())
    monkeypatch.setattr(ml, "GRID", {"maxDepth": [1, 3], "numTrees": [3]})
    out = ml.train_classifier(df, "id", ["x1", "x2"], "label", search=True, path=str(tmp_path / "model")).cache()
    assert out.count() == 240 and out.where("y = prediction").count() > 120
    model = RandomForestClassificationModel.load(str(tmp_path / "model"))
    assert model.getNumTrees == 3 and model.numClasses == 3
    dealt = ml.stratified_folds(ml.assemble(df, ["x1", "x2"], "label"), "id", "y", 3)
    table = ml.search_table(dealt).collect()
    assert {(r.maxDepth, r.numTrees, r.fold) for r in table} == {(d, 3, k) for d in (1, 3) for k in range(3)}
    assert all(sum(r.n for r in table if r.maxDepth == d) == 240 and r.correct <= r.n for d in (1, 3) for r in table)
    best = max((1, 3), key=lambda d: sum(r.correct / r.n for r in table if r.maxDepth == d))
    assert ml.best_settings(ml.search_table(dealt))["maxDepth"] == best
    report = {r.c: r for r in ml.classification_report(out).collect()}
    assert sum(r.support for r in report.values()) == 240


def test_one_fit_for_nested_forests(spark, monkeypatch):
    """Depths and numbers of trees share a fit. With two features every node tries both, so a shallow forest is what Spark grows alone."""
    rng = random.Random(2)
    rows = [(i, k, rng.gauss(1.2 * (k == "a"), 1), rng.gauss(1.2 * (k == "b"), 1)) for i in range(600) for k in ["abc"[i % 3]]]
    data = ml.assemble(spark.createDataFrame(rows, "id long, label string, x1 double, x2 double"), ["x1", "x2"], "label")
    dealt = ml.stratified_folds(data, "id", "y", 2).cache()
    fitted = []
    fit = ml.RandomForestClassifier.fit
    monkeypatch.setattr(ml.RandomForestClassifier, "fit", lambda self, df: fitted.append(1) or fit(self, df))
    monkeypatch.setattr(ml, "GRID", {"maxDepth": [1, 2, 4], "numTrees": [5, 8], "minInstancesPerNode": [1, 4]})
    table = ml.search_table(dealt).collect()
    assert len(table) == 24 and len(fitted) == 4
    for r in table:
        test = dealt.where(f"fold = {r.fold}")
        assert r.n == 300
        if r.numTrees == 8:
            alone = ml.RandomForestClassifier(featuresCol="x", labelCol="y", seed=ml.SEED, maxDepth=r.maxDepth, numTrees=8, minInstancesPerNode=r.minInstancesPerNode)
            assert r.correct == fit(alone, dealt.where(f"fold <> {r.fold}")).transform(test).where("y = prediction").count(), r
