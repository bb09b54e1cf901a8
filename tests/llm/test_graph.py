from __future__ import annotations

import random

from pyspark.sql import functions as F

from skyrill.llm import graph
from skyrill.llm.shared import bounded_sample, stage


def union_find(edges):
    label = {x: x for e in edges for x in e}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return {x: find(x) for x in label}


def test_components_of_random_graphs_and_a_path(spark):
    rng = random.Random(1)
    for edges in ([(rng.randrange(80), rng.randrange(80)) for _ in range(50)], [(i, i + 1) for i in range(40)], [(9, k) for k in range(9)], []):
        df = spark.createDataFrame(edges, "a long, b long") if edges else spark.createDataFrame([], "a long, b long")
        got = {r.node: r.label for r in graph.components(df).collect()}
        want = union_find([e for e in edges if e[0] != e[1]])
        assert got == want


def test_resolve_is_exact_where_stars_miss_links(spark, monkeypatch):
    """Links are given; buckets are large and their smallest node is mostly linked with nothing."""
    rng = random.Random(3)
    links = {tuple(sorted(rng.sample(range(1, 120), 2))) for _ in range(60)}
    buckets = [(k, {0, *e, *(rng.randrange(120) for _ in range(12))}) for k, e in enumerate(sorted(links))]
    rows = [(k, n, min(m)) for k, m in buckets for n in m]
    shared = stage(spark.createDataFrame(rows, "bucket long, node long, c long"), "test-members")
    known = spark.createDataFrame(sorted(links), "a long, b long")
    size = spark.createDataFrame([(n, n % 5) for n in range(120)], "node long, five int")
    far = [e for e in links if abs(e[0] % 5 - e[1] % 5) < 4]
    for graph_rounds, block in ((0, 3), (3, 512)):
        monkeypatch.setattr(graph, "STAR_ROUNDS", graph_rounds)
        monkeypatch.setattr(graph, "BLOCK", block)
        got = {r.node: r.label for r in graph.resolve(shared, lambda p: p.join(known, ["a", "b"])).collect()}
        assert got == union_find(links)
        some = spark.createDataFrame(far, "a long, b long")
        got = {r.node: r.label for r in graph.resolve(shared, lambda p: p.join(some, ["a", "b"]), size, "abs(five - fivex) < 4").collect()}
        assert got == union_find(far)


def test_bounded_sample(spark):
    df = spark.range(10_000)
    assert bounded_sample(df, 20_000, "id").count() == 10_000
    assert 800 < bounded_sample(df, 1000, "id").count() <= 2000
    assert bounded_sample(df.select(F.lit(1).alias("id")), 100, "id").count() <= 200


def test_paths_without_a_scheme_are_qualified(spark):
    from skyrill.llm.shared import qualified

    assert qualified(spark, "/some/folder/") == "file:///some/folder"
    assert qualified(spark, "hdfs://host/x") == "hdfs://host/x" and qualified(spark, "file:///y/") == "file:///y"
