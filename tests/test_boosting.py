"""Boosted trees against plain loops that grow one leaf at a time."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from skyrill.operators import boosting as B


def plain_model(rows, n_classes, s, borders):
    """Scores of all rows after all rounds: one leaf after another is split, the one of most gain first."""
    bins = [[0 if x is None else 1 + sum(b < x for b in bs) for x, bs in zip(xs, borders)] for xs, _ in rows]
    known = [i for i, (_, y) in enumerate(rows) if y is not None]
    n = Counter(rows[i][1] for i in known)
    scores = [[math.log(n[k] / len(known)) for k in range(n_classes)] for _ in rows]
    factor = n_classes / (n_classes - 1)
    for _ in range(s.rounds):
        p = []
        for z in scores:
            e = [math.exp(x - max(z)) for x in z]
            p.append([x / sum(e) for x in e])
        for k in range(n_classes):
            g = [p[i][k] - (rows[i][1] == k) for i in range(len(rows))]
            h = [factor * p[i][k] * (1 - p[i][k]) for i in range(len(rows))]

            def best(leaf):
                mine = [i for i in leaf if rows[i][1] is not None]
                out = (0.0, 0, 0)
                for f in range(len(borders)):
                    for b in range(s.bins + 1):
                        left, right = [i for i in mine if bins[i][f] <= b], [i for i in mine if bins[i][f] > b]
                        if min(len(left), len(right)) < s.min_rows:
                            continue
                        gain = -(sum(g[i] for i in mine) ** 2) / sum(h[i] for i in mine)
                        gain += sum(sum(g[i] for i in side) ** 2 / sum(h[i] for i in side) for side in (left, right))
                        if round(gain, B.DIGITS) > out[0]:
                            out = (round(gain, B.DIGITS), f, b)
                return out

            leaves = [(best(range(len(rows))), list(range(len(rows))))]
            while len(leaves) < s.leaves:
                at = max(range(len(leaves)), key=lambda j: leaves[j][0][0])
                (gain, f, b), leaf = leaves[at]
                if gain <= 0:
                    break
                sides = [i for i in leaf if bins[i][f] <= b], [i for i in leaf if bins[i][f] > b]
                leaves[at : at + 1] = [(best(side), side) for side in sides]
            for _, leaf in leaves:
                mine = [i for i in leaf if rows[i][1] is not None]
                value = -s.rate * sum(g[i] for i in mine) / sum(h[i] for i in mine)
                for i in leaf:
                    scores[i][k] += value
    out = []
    for z in scores:
        e = [math.exp(x - max(z)) for x in z]
        out.append([x / sum(e) for x in e])
    return out


@pytest.fixture(scope="module")
def table(spark):
    """Three classes that interact in two features, with missing, infinite and equal values and rows without a class."""
    rng = random.Random(3)
    rows = []
    for i in range(150):
        x = [rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(3)), 1.0]
        y = int((x[0] > 0) != (x[1] > 0.3)) + (x[2] == 2 and rng.random() < 0.8)
        x = [None if rng.random() < 0.05 else v for v in x]
        rows.append((x, None if i % 30 == 7 else y))
    records = [(i, None if y is None else "abc"[y], *[float("inf") if v is None and i % 2 else v for v in x]) for i, (x, y) in enumerate(rows)]
    return rows, spark.createDataFrame(records, "id long, label string, x1 double, x2 double, `x.3` double, x4 double").repartition(3).withColumnRenamed("x.3", "x3")


FEATURES = ["x1", "x2", "x3", "x4"]


@pytest.mark.parametrize("task_bytes", [1000, 1 << 20])
def test_equals_plain_loops(spark, table, monkeypatch, task_bytes):
    """From one task, and from several whose histograms meet."""
    rows, df = table
    monkeypatch.setattr(B, "REPLAY", 2)
    monkeypatch.setattr(B, "TASK_BYTES", task_bytes)
    s = B.Settings(rounds=3, rate=0.3, leaves=6, min_rows=5, bins=8)
    model = B.fit(df, FEATURES, "label", s)
    assert model.classes == ["a", "b", "c"] and [len(x) <= 7 for x in model.borders]
    want = plain_model(rows, 3, s, model.borders)
    got = {r.id: r for r in model.probabilities(df, "id", "label").collect()}
    assert len(got) == len(rows)
    for i, p in enumerate(want):
        assert got[i].probabilities == pytest.approx(p, abs=1e-9)
        assert got[i].prediction == "abc"[max(range(3), key=lambda k: (p[k], -k))]
    depths = [len(t[0]) for trees in model.rounds for t in trees]
    assert max(depths) == 11 and sum(got[i].prediction == got[i].label for i in got) > 120


def test_rows_are_dealt_to_all_slots(spark, table, monkeypatch):
    """A table far below the bytes of one task is not left to one task, and the trees stay the same."""
    rows, df = table
    s = B.Settings(rounds=2, rate=0.3, leaves=6, min_rows=5, bins=8)
    one = B.fit(df, FEATURES, "label", s)
    parts, grow = [], B._grow
    monkeypatch.setattr(B, "LEAST_BYTES", 500, raising=False)
    monkeypatch.setattr(B, "_grow", lambda state, *rest: parts.append(state.rdd.getNumPartitions()) or grow(state, *rest))
    several = B.fit(df, FEATURES, "label", s)
    assert parts and min(parts) > 1
    for a, b in zip((t for trees in one.rounds for t in trees), (t for trees in several.rounds for t in trees)):
        assert all((x == y).all() for x, y in zip(a[:3], b[:3])) and a[3] == pytest.approx(b[3], abs=1e-12)


def test_saved_model_predicts_alike(spark, table, tmp_path):
    _, df = table
    model = B.fit(df, FEATURES, "label", B.Settings(rounds=2, leaves=4, min_rows=8, bins=16))
    model.save(spark, str(tmp_path / "model"))
    again = B.Boosted.load(spark, str(tmp_path / "model"))
    first, second = ({r.id: (r.probabilities, r.prediction) for r in m.probabilities(df, "id").collect()} for m in (model, again))
    assert first == second
    splits = {r.feature: r.splits for r in model.importance(spark).collect()}
    assert sum(splits.values()) == sum((t[2] >= 0).sum() for trees in model.rounds for t in trees) > 0


def test_one_class_and_none(spark):
    kind = "id long, label string, x double"
    one = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, None, 2.0)], kind)
    assert [(r.probabilities, r.prediction) for r in B.fit(one, ["x"], "label").probabilities(one, "id").collect()] == [([1.0], "a")] * 3
    flat = spark.createDataFrame([(i, "ab"[i % 2], 1.0) for i in range(60)], kind)
    model = B.fit(flat, ["x"], "label")
    assert not model.rounds and {tuple(r.probabilities) for r in model.probabilities(flat, "id").collect()} == {(0.5, 0.5)}
    for rows in ([], [(1, None, 1.0)]):
        with pytest.raises(ValueError):
            B.fit(spark.createDataFrame(rows, kind), ["x"], "label")
    assert B.fit(one, ["x"], "label").probabilities(one.where("id > 9"), "id").count() == 0


def test_few_rows_are_dealt_by_class(spark, table, monkeypatch):
    """A round over few rows takes no pass of its own for each depth, and its trees are those of passes over dealt rows."""
    _, df = table
    s = B.Settings(rounds=4, rate=0.3, leaves=6, min_rows=5, bins=8)
    passes, best = [], B._best_splits
    monkeypatch.setattr(B, "_best_splits", lambda *a: passes.append(1) or best(*a))
    few = B.fit(df, FEATURES, "label", s)
    assert not passes and len(few.rounds) == 4
    monkeypatch.setattr(B, "TASK_BYTES", 1000)
    many = B.fit(df, FEATURES, "label", s)
    assert len(passes) > 4
    for a, b in zip((t for trees in few.rounds for t in trees), (t for trees in many.rounds for t in trees)):
        assert all((x == y).all() for x, y in zip(a[:3], b[:3])) and a[3] == pytest.approx(b[3], abs=1e-12)
