from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skyrill.llm import mixing


def targets_of(words, share=1.5, weights=(3, 1, 2), cap=2):
    """Shares by weight, one source after another held at its cap, by plain loops."""
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    held = set()
    while True:
        left = share * sum(words.values()) - sum(cap * words[s] for s in held)
        total = sum(weight[s] for s in order if s not in held)
        target = {s: cap * words[s] if s in held else left * weight[s] / total for s in order}
        more = {s for s in order if s not in held and target[s] > cap * words[s]}
        if not more:
            return target
        held |= more


def corpus(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(3000):
        source = rng.choice(["hot"] * 6 + ["b", "é", "z", None, "src10", "src9", "one"][: 6 + (i == 5)])
        n = int(rng.lognormvariate(4, 1)) if i % 50 else 20_000 if i == 100 else 0
        rows.append((i, "".join(rng.choice([" ", "\n", "\t\r", "  "]) + "w é"[: rng.randint(1, 3)] for _ in range(n)), source, "x"))
    rows += [(5001, None, "empty", "x"), (5002, " \n", "empty", "x"), (5003, "a b c", "one", "x"), (5004, "same words here", "b", "x"), (5004, "same words here", "b", "x"), (None, "no id at all", "b", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, SIZE string")


def test_mix_against_plain_loops(spark):
    rows, df = corpus(spark)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter((i, s, size(t)) for i, t, s, _ in rows)
    words = Counter()
    for _, t, s, _ in rows:
        words[s] += size(t)
    words = dict(words)
    target, taken, smallest = targets_of(words), Counter(), defaultdict(lambda: 10**9)
    for r in out:
        assert r.source_size == words[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9)
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        if r.size:
            smallest[r.source] = min(smallest[r.source], r.size)
    for s in words:
        assert abs(taken[s] - target[s]) <= max(1.0, 0.001 * target[s]), (s, taken[s], target[s])
    assert math.isclose(sum(target.values()), 1.5 * sum(words.values()), rel_tol=1e-9)


def test_rates_are_the_tilts_of_the_dual(spark):
    """The words of min(cap, exp(tilt * size)) are the target: the only stationary point of the convex dual."""
    rng = random.Random(4)
    sizes = [(s, k, rng.randint(1, 30)) for s in ("a", "b", "c", "d", None) for k in sorted({int(rng.lognormvariate(5, 1.5)) + 1 for _ in range(200)})]
    words = Counter()
    for s, k, n in sizes:
        words[s] += k * n
    share = {"a": 0.02, "b": 0.6, "c": 1.0, "d": 1.99, None: 2.0}
    targets = [(s, words[s], words[s] * share[s]) for s in share]
    tilts = mixing.solve_tilts(spark.createDataFrame(sizes, "source string, size long, n long"), spark.createDataFrame(targets, "source string, words long, target double")).collect()
    assert len(tilts) == 5
    for r in tilts:
        if r.source is None:
            assert r.tilt is None
            continue
        got = sum(n * k * min(2, math.exp(min(r.tilt * k, 1))) for s, k, n in sizes if s == r.source)
        assert math.isclose(got, words[r.source] * share[r.source], rel_tol=1e-7)


@pytest.mark.parametrize("parts", [1, 7])
def test_result_does_not_depend_on_partitions(spark, parts):
    _, df = corpus(spark, 2)
    key = lambda r: tuple((x is not None, x) for x in r)
    first = sorted(map(tuple, mixing.mix(df).collect()), key=key)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts + 2))
    try:
        assert sorted(map(tuple, mixing.mix(df.repartition(parts, F.rand(3))).collect()), key=key) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_empty_and_wordless_tables(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], kind)).count() == 0
    rows = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], kind)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.copies) for r in rows) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_long_text(spark):
    rows = [(1, "word " * 1_000_000, "a"), (2, "a few words", "a"), (3, "and a few more words", "b")]
    out = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[1].size == 1_000_000 and all(r.copies <= 2 for r in out.values())
