"""Neighbour embedding: a graph of nearest neighbours, weights on its edges, and a layout in the plane.

Neighbours. Each of some trees cuts the space by random directions at their medians; points with
the same sides are a cell, large cells are cut into blocks by a hash, and a block (of
bounded size) gives each of its points the nearest ones in it. Then rounds of
descent: a point introduces the points around it (its neighbours, and a bounded
number of those it is a neighbour of) to each other. Only lists of neighbours leave a block; pairs are never rows.

Weights. A point's nearest neighbour has weight 1, and the others fall off at a
rate by which they add up to the logarithm of their number; an edge that both ends have takes the
probability that at least one holds.

Layout. From two principal components, points move in rounds along their
edges and away from a bounded sample of points, with steps that shrink. Each round is two
joins of the edges with the positions and one grouped sum.

Defined results: a missing or infinite value counts as 0; rows of one key are one
point, the one of least values; a null key is a point like others; a table of two points keeps its
first positions, a single point lies at the origin; an empty one gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..sources.scratch import staged

#: Neighbours, distance of neighbours in the plane and seed of the usual embedding.
NEIGHBOURS = 20
MIN_DISTANCE = 0.05
SEED = 42
#: Trees, points in a block (about), rounds of descent, and points that a point is a neighbour of, at most, which it introduces.
TREES = 8
BLOCK = 256
DESCENTS = 3
REVERSE = 20
#: Rounds of the layout, points that all others move away from in a round, and how many of them one point meets.
ROUNDS = 40
SAMPLE = 1024
REPEL = 15


def _points(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(id, x): a number for each key, and its values."""
    x = F.array(*[F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)) for c in columns])
    return rows.groupBy(F.col(key).alias("key")).agg(F.min(x).alias("x")).select("key", F.xxhash64("key").alias("id"), "x")


def _directions(n: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(n, width))


def _top(owner: np.ndarray, other: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` nearest of each owner, ties by the other's number."""
    order = np.lexsort((other, distance, owner))
    owner, other, distance = owner[order], other[order], distance[order]
    first = np.searchsorted(owner, owner, side="left")
    keep = np.arange(len(owner)) - first < k
    return owner[keep], other[keep], distance[keep]


def _around(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Places in ``ids`` and (other, d): the ``k`` nearest among the points of a block, for each of them."""
    square = (x**2).sum(axis=1)
    d = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * x @ x.T, 0.0))
    np.fill_diagonal(d, np.inf)
    k = min(k, len(ids) - 1)
    near = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), int)
    row = np.repeat(np.arange(len(ids)), k)
    # Differences once more for those that stay: products cancel for close points.
    exact = np.sqrt(((x[row] - x[near.reshape(-1)]) ** 2).sum(axis=1))
    return row, ids[near.reshape(-1)], exact


EDGES = "id long, other long, d double"


def _near(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(id, other, d): the ``k`` nearest of each point (keys, id, w, x) among those of equal ``keys``, without those farther away than its ``w``.

    A group's rows meet in one task, in order, and are told apart there: many small groups need no table each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _and_end(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                *group, ids, w, x = batch.columns
                fresh = np.stack([g.to_numpy() for g in group], 1).astype(np.int64), ids.to_numpy(), w.to_numpy(), x.flatten().to_numpy().reshape(len(ids), -1)
                held = fresh if held is None else tuple(np.concatenate(p) for p in zip(held, fresh))
            if held is None:
                continue
            group, ids, w, x = held
            ends = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            # The last group may go on in the next batch.
            bounds = [0, *ends] if batch is not None else [0, *ends, len(ids)]
            held = tuple(p[bounds[-1] :] for p in held)
            found = []
            for a, b in zip(bounds, bounds[1:]):
                row, other, d = _around(ids[a:b], x[a:b], k)
                close = d <= w[a:b][row]
                found.append((ids[a:b][row[close]], other[close], d[close]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in zip(*found)], ["id", "other", "d"])

    met = rows.select(*keys, "id", "w", "x").repartition(*keys).sortWithinPartitions(*keys, "id")
    return met.mapInArrow(run, EDGES)


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, and None once they have ended."""
    yield from batches
    yield None


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest distinct others of each id, by lists of bounded length on the map side."""
    lists = edges.distinct().groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "other"))).alias("l"))
    return lists.select("id", F.explode(F.slice("l", 1, k)).alias("e")).select("id", "e.other", "e.d")


def nearest(points: DataFrame, k: int = NEIGHBOURS, trees: int = TREES, block: int = BLOCK, descents: int = DESCENTS, seed: int = SEED) -> DataFrame:
    """(id, other, d): about the ``k`` nearest neighbours of each point (id, x), a staged table of distinct ids."""
    n = points.count()
    some = points.first()
    if some is None or n < 2:
        return points.sparkSession.createDataFrame([], EDGES)
    k = min(k, n - 1)
    depth = max(0, math.ceil(math.log2(n / block)))
    split = _directions(trees * depth, len(some.x), seed).reshape(trees, depth, len(some.x))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            sides = x @ split.reshape(trees * depth, -1).T if len(x) else np.zeros((0, trees * depth))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(sides), pa.list_(pa.float64()))], ["id", "x", "p"])

    if depth:
        placed = staged(points.select("id", "x").mapInArrow(project, "id long, x array<double>, p array<double>"), "projected")
        middle = placed.agg(*[F.percentile_approx(F.col("p")[i], 0.5, F.lit(1000)).alias(f"m{i}") for i in range(trees * depth)]).first()
        bit = lambda t, i: F.when(F.col("p")[t * depth + i] > float(middle[t * depth + i]), 1 << i).otherwise(0)
        cells = [sum((bit(t, i) for i in range(1, depth)), bit(t, 0)) for t in range(trees)]
    else:
        placed, cells = points.select("id", "x"), [F.lit(0)]
    member = placed.select("id", "x", F.posexplode(F.array(*cells)).alias("tree", "cell"))
    sizes = member.groupBy("tree", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    member = member.join(F.broadcast(sizes) if trees << depth < 100_000 else sizes, ["tree", "cell"])
    member = member.withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.col("blocks")))

    edges = staged(_best(_near(member.withColumn("w", F.lit(math.inf)), ["tree", "cell", "part"], k), k), "edges")
    for r in range(descents):
        edges = staged(_descend(points, edges, k, seed + r), "edges")
    return edges


def _descend(points: DataFrame, edges: DataFrame, k: int, seed: int) -> DataFrame:
    """Each point introduces those around it, and itself, to each other; the best of old and new neighbours stay.

    A point that has ``k`` neighbours takes no farther ones, so those end where they are found.
    """
    order = F.xxhash64("id", "other", F.lit(seed))
    # At most REVERSE of a hub's admirers, by least hash: minima of a few cells, so no list of all is made.
    cell = F.pmod(order, F.lit(REVERSE))
    admirers = edges.groupBy(F.col("other").alias("host"), cell.alias("cell")).agg(F.min(F.struct(order.alias("h"), F.col("id").alias("guest"))).alias("g")).select("host", "g.guest")
    guests = edges.select(F.col("id").alias("host"), F.col("other").alias("guest")).union(admirers).union(points.select("id", "id")).distinct()
    worst = edges.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).alias("w"))
    known = points.select("id", "x").join(worst, "id", "left").withColumn("w", F.coalesce("w", F.lit(math.inf)))
    seated = guests.withColumnRenamed("guest", "id").join(known, "id")
    return _best(edges.union(_near(seated, ["host"], k // 2 + 1)), k)


def recall(points: DataFrame, edges: DataFrame, k: int = NEIGHBOURS, every: int = 20) -> float:
    """Share of the true ``k`` nearest neighbours that ``edges`` has, of the points whose id is divisible by ``every``, against all points."""
    asked = points.where(F.pmod("id", F.lit(every)) == 0).select("id", "x").collect()
    if not asked:
        return 1.0
    ids, x = np.array([r.id for r in asked]), np.array([r.x for r in asked], float)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            if batch.num_rows:
                other, y = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), float)
                d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
                owner, known = np.repeat(ids, len(other)), np.tile(other, len(ids))
                new = owner != known
                best = _top(*(np.concatenate([a, b[new]]) for a, b in zip(best, (owner, known, d.reshape(-1)))), k)
        yield pa.RecordBatch.from_arrays(list(map(pa.array, best)), ["id", "other", "d"])

    true = _best(points.select("id", "x").mapInArrow(scan, EDGES), k)
    n, hit = true.join(edges.select("id", "other", F.lit(1).alias("hit")), ["id", "other"], "left").agg(F.count(F.lit(1)), F.count("hit")).first()
    return hit / n if n else 1.0


def weights(edges: DataFrame) -> DataFrame:
    """(a, b, w), a < b: how surely two points are neighbours."""

    @F.pandas_udf("array<double>")
    def fall_off(distances: pd.Series) -> pd.Series:
        out = []
        for d in distances:
            d = np.asarray(d, float)
            d = np.maximum(d - (d[d > 0].min() if (d > 0).any() else 0.0), 0.0)
            want, low, high = math.log2(max(len(d), 2)), 0.0, np.inf
            rate = 1.0
            for _ in range(64):
                total = np.exp(-d / rate).sum()
                low, high = (low, rate) if total > want else (rate, high)
                rate = (low + high) / 2 if np.isfinite(high) else rate * 2
            out.append(np.exp(-d / max(rate, 1e-3 * d.mean() if d.mean() > 0 else 1e-12)))
        return pd.Series(out)

    lists = edges.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "other"))).alias("l"))
    each = lists.select("id", F.col("l.other").alias("other"), fall_off(F.col("l.d")).alias("w"))
    each = each.select("id", F.explode(F.arrays_zip("other", "w")).alias("e")).select(F.least("id", "e.other").alias("a"), F.greatest("id", "e.other").alias("b"), "e.w")
    total = F.sum("w")
    return each.groupBy("a", "b").agg((total - (total * total - F.sum(F.col("w") * F.col("w"))) / 2).alias("w"))


def curve(min_distance: float = MIN_DISTANCE) -> tuple[float, float]:
    """(a, b) by which 1 / (1 + a d^(2 b)) is nearest to a fall from 1 at ``min_distance`` by exp(min_distance - d)."""
    d = np.linspace(1e-3, 3.0, 300)
    want = np.where(d < min_distance, 1.0, np.exp(min_distance - d))
    p = np.array([1.0, 1.0])
    for _ in range(100):
        power = d ** (2 * p[1])
        f = 1 / (1 + p[0] * power)
        slope = np.stack([-power * f**2, -2 * p[0] * power * np.log(d) * f**2], 1)
        p = p + np.linalg.lstsq(slope, want - f, rcond=None)[0]
    return float(p[0]), float(p[1])


def layout(points: DataFrame, graph: DataFrame, start: DataFrame, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(id, u, v): positions of all ``points`` after ``rounds``, from ``start`` (id, u, v), a staged table; ``graph`` has (a, b, w)."""
    a, b = curve()
    both = staged(graph.select(F.col("a").alias("id"), F.col("b").alias("other"), "w").union(graph.select("b", "a", "w")), "graph")
    n = points.count()
    cut = (1 << 63) - 1 if n <= SAMPLE else int(SAMPLE / n * 2**64) - 2**63
    at = start
    for r in range(rounds):
        rate = 1.0 - r / rounds
        there = at.select(F.col("id").alias("other"), F.col("u").alias("u1"), F.col("v").alias("v1"))
        e = both.join(at, "id").join(there, "other")
        du, dv = F.col("u") - F.col("u1"), F.col("v") - F.col("v1")
        square = du * du + dv * dv
        pull = F.when(square > 0, -2.0 * a * b * F.pow(square, F.lit(b - 1)) / (1.0 + a * F.pow(square, F.lit(b)))).otherwise(0.0) * F.col("w")
        clip = lambda x: F.least(F.greatest(x, F.lit(-4.0)), F.lit(4.0))
        pulls = e.groupBy("id").agg(F.sum(clip(pull * du)).alias("pu"), F.sum(clip(pull * dv)).alias("pv"), F.sum("w").alias("w"))
        # A sample of bounded size, met by every point where it lies.
        others = at.where(F.xxhash64("id", F.lit(seed), F.lit(r)) <= cut).orderBy("id").limit(2 * SAMPLE).collect()
        moved = at.join(pulls, "id", "left").mapInArrow(_pushed(np.array([(o.u, o.v) for o in others]), a, b, rate, seed + r), "id long, u double, v double")
        at = staged(moved, "positions")
    return at


def _pushed(others: np.ndarray, a: float, b: float, rate: float, seed: int):
    """Positions moved by their pulls and by the push of some of ``others``, which each point draws by its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, u, v, pu, pv, w = (c.fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns)
            push = np.zeros((len(ids), 2))
            here = np.stack([u, v], 1)
            for k in range(REPEL):
                mixed = (ids.astype(np.uint64) + np.uint64(seed * 1000 + k)) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                away = here - others[((mixed >> np.uint64(33)) % np.uint64(len(others))).astype(int)]
                square = (away**2).sum(axis=1, keepdims=True)
                force = 2.0 * b / ((0.001 + square) * (1.0 + a * square**b))
                push += np.where(square > 0, np.clip(force * away, -4.0, 4.0), 0.0)
            pull = np.stack([pu, pv], 1) / np.maximum(w, 1e-9)[:, None]
            step = rate * (pull + push / REPEL * np.minimum(w, 1.0)[:, None])
            end = np.round(here + step, 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(end[:, 0]), pa.array(end[:, 1])], ["id", "u", "v"])

    return run


def _start(points: DataFrame) -> DataFrame:
    """(id, u, v): two principal components, the wider of which has a spread of some units."""
    vectors = points.select("id", array_to_vector("x").alias("x"))
    model = PCA(k=min(2, len(points.first().x)), inputCol="x", outputCol="pc").fit(vectors)
    pc = vector_to_array("pc")
    flat = model.transform(vectors).select("id", pc[0].alias("u"), F.coalesce(F.get(pc, F.lit(1)), F.lit(0.0)).alias("v"))
    m = flat.agg(F.avg("u").alias("u"), F.avg("v").alias("v"), F.stddev_pop("u").alias("s")).first()
    return flat.select("id", *[(((F.col(c) - m[c]) / (m.s or 1.0)) * 4.0).alias(c) for c in ("u", "v")])


def embed(rows: DataFrame, key: str, columns: list[str], k: int = NEIGHBOURS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(key, u, v): two coordinates of each key."""
    points = staged(_points(rows, key, columns), "points")
    if points.limit(2).count() < 2:
        return points.select(F.col("key").alias(key), F.lit(0.0).alias("u"), F.lit(0.0).alias("v"))
    start = staged(_start(points), "positions")
    if points.limit(3).count() > 2:
        graph = weights(nearest(points, k, seed=seed))
        start = layout(points, graph, start, rounds, seed)
    return points.select("key", "id").join(start, "id").select(F.col("key").alias(key), "u", "v")
