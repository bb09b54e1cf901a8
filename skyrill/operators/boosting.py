"""Gradient-boosted trees for several classes, grown best-first from grouped histograms.

Features are cut into bins at quantiles, once. In each round every class gets a
tree on the gradients of the softmax loss. Tasks add the gradients of their
rows by (class, leaf, feature, bin); the histograms of a leaf, one from each
task, are dealt to one task, added, and give its best split. What
the driver holds is the model: a bounded number of leaves for each class and
round. All classes, and all leaves that may still be split, share one pass over the
rows. Splits are taken in order of gain until a tree has its leaves; passes go on
until every split that this order takes has children whose gains are known, so
the tree is the best-first tree, whatever the order in which gains arrived.
Where all rows are no more than one task reads anyway, each class gets a task that has their gradients and grows its
tree to the end by the same steps: a round is one job then, and its passes stay in the task.

Rows keep a byte for each feature and a score for each class in a staged table,
which is rewritten every few rounds; rounds since then are replayed by the tasks.

Defined results: a missing or infinite feature is in a bin below all others; a
null class is not learned from but predicted; classes are numbered in
alphabetical order; equal gains go to the first feature, then to the lowest
bin; rounds end early when no class has a leaf to split; with one class only its probability is 1; without rows of a known class,
and for an empty table, there is nothing to learn, which is an error.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..sources.scratch import staged

#: Quantile sketches of the bin borders err by one in so many ranks.
ACCURACY = 10_000
#: Rounds between two rewrites of the staged scores, bytes of staged rows that one task reads at most (where all are no more, classes are dealt), and
#: those from which a task is worth its start: between the two, rows are dealt to as many tasks as run at once.
REPLAY = 3
TASK_BYTES = 32 << 20
LEAST_BYTES = 512 << 10
#: Nodes whose histograms one task adds, about.
NODES = 16
#: Gains are compared at so many digits, so that the order in which sums were added decides nothing.
DIGITS = 9


@dataclass(frozen=True)
class Settings:
    """Fixed values by default: rate, leaves and rounds of the usual multi-class booster."""

    rounds: int = 100
    rate: float = 0.1
    leaves: int = 31
    min_rows: int = 20
    min_hessian: float = 1e-3
    bins: int = 32


@dataclass
class Tree:
    """Nodes in order of birth; a split sends bins up to ``bin`` to ``left`` and the rest to ``left + 1``."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    #: Splits of a node by gain, filled in when its histogram is known: (gain, feature, bin, left sums, right sums).
    best: dict[int, tuple] = field(default_factory=dict)
    sums: list[tuple[float, float, int]] = field(default_factory=list)

    def add(self, sums: tuple[float, float, int]) -> int:
        self.feature.append(-1), self.bin.append(0), self.left.append(-1), self.value.append(0.0), self.sums.append(sums)
        return len(self.feature) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature, np.int32), np.array(self.bin, np.int32), np.array(self.left, np.int32), np.array(self.value)


def descend(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The node in which each row of a (rows, features) matrix of bins ends."""
    feature, cut, left, _ = tree
    node = np.zeros(len(bins), np.int32)
    open_rows = np.arange(len(bins)) if left[0] >= 0 else np.zeros(0, int)
    while len(open_rows):
        at = node[open_rows]
        node[open_rows] = left[at] + (bins[open_rows, feature[at]] > cut[at])
        open_rows = open_rows[left[node[open_rows]] >= 0]
    return node


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """A column of equally long binaries as a matrix, a view of its values."""
    if not len(column):
        return np.zeros((0, width), kind)
    _, offsets, values = column.buffers()
    start = int(np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset])
    return np.frombuffer(values, kind, len(column) * width, start).reshape(len(column), width)


def _packed(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(matrix)], pa.binary())


def _replayed(scores: np.ndarray, bins: np.ndarray, rounds: list[list[tuple]]) -> np.ndarray:
    scores = scores.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            scores[:, k] += tree[3][descend(tree, bins)]
    return scores


class Boosted:
    """A model: bin borders of each feature, class names, first scores, and a tree for each round and class."""

    def __init__(self, features: list[str], borders: list[list[float]], classes: list[str], first: list[float]):
        self.features, self.borders, self.classes, self.first = features, borders, classes, first
        self.rounds: list[list[tuple]] = []

    def binned(self, rows: DataFrame, *keep: str) -> DataFrame:
        """``keep`` and ``bins``, a byte for each feature: 0 if it is missing, else one more than the borders below it."""
        borders, n = self.borders, len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = np.zeros((batch.num_rows, n), np.uint8)
                for f in range(n):
                    x = batch.column(len(keep) + f).to_numpy(zero_copy_only=False).astype(float)
                    out[:, f] = np.where(np.isnan(x), 0, 1 + np.searchsorted(borders[f], x, side="left"))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), _packed(out)], [*keep, "bins"])

        kinds = dict(rows.dtypes)
        table = rows.select(*keep, *[finite(F.col(f).cast("double")).alias(f) for f in self.features])
        return table.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "bins binary"]))

    def probabilities(self, rows: DataFrame, *keep: str) -> DataFrame:
        """``keep``, ``probabilities`` of the classes in order, and ``prediction``, the first class of the highest one."""
        rounds, first, n, classes = self.rounds, np.array(self.first), len(self.features), self.classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = _matrix(batch.column(len(keep)), np.uint8, n)
                p = softmax(_replayed(np.tile(first, (len(bins), 1)), bins, rounds)) if len(bins) else np.zeros((0, len(first)))
                lists = pa.ListArray.from_arrays(np.arange(len(bins) + 1, dtype=np.int32) * len(first), p.reshape(-1))
                said = pa.array([classes[k] for k in p.argmax(axis=1)], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), lists, said], [*keep, "probabilities", "prediction"])

        kinds = dict(rows.dtypes)
        return self.binned(rows, *keep).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "probabilities array<double>, prediction string"]))

    def nodes(self, spark) -> DataFrame:
        """The model as rows (round, class, node, feature, threshold, left, value): ``threshold`` is the largest value that goes left."""
        out = []
        for r, trees in enumerate(self.rounds):
            for k, (feature, cut, left, value) in enumerate(trees):
                for i in range(len(left)):
                    leaf = left[i] < 0
                    border = None if leaf else float("-inf") if not cut[i] else self.borders[feature[i]][cut[i] - 1]
                    out.append((r, self.classes[k], i, None if leaf else self.features[feature[i]], border, None if leaf else int(left[i]), float(value[i]) if leaf else None))
        return spark.createDataFrame(out, "round int, class string, node int, feature string, threshold double, left int, value double")

    def save(self, spark, path: str) -> None:
        """Nodes and heads as Parquet under ``path``, which must not hold a model yet."""
        self.nodes(spark).coalesce(1).write.parquet(f"{path}/nodes")
        heads = [("feature", i, f, [float(x) for x in b]) for i, (f, b) in enumerate(zip(self.features, self.borders))]
        heads += [("class", i, c, [float(x)]) for i, (c, x) in enumerate(zip(self.classes, self.first))]
        spark.createDataFrame(heads, "kind string, place int, name string, numbers array<double>").coalesce(1).write.parquet(f"{path}/heads")

    @staticmethod
    def load(spark, path: str) -> Boosted:
        heads = sorted(spark.read.parquet(f"{path}/heads").collect(), key=lambda r: r.place)
        of = lambda kind: [r for r in heads if r.kind == kind]
        model = Boosted([r.name for r in of("feature")], [r.numbers for r in of("feature")], [r.name for r in of("class")], [r.numbers[0] for r in of("class")])
        place = {f: i for i, f in enumerate(model.features)}
        trees: dict[tuple, list] = {}
        for r in sorted(spark.read.parquet(f"{path}/nodes").collect(), key=lambda r: r.node):
            leaf = r.left is None
            cut = 0 if leaf else int(np.searchsorted(model.borders[place[r.feature]], r.threshold, side="right"))
            trees.setdefault((r["round"], r["class"]), []).append((-1 if leaf else place[r.feature], cut, -1 if leaf else r.left, r.value or 0.0))
        for r in range(1 + max((k[0] for k in trees), default=-1)):
            columns = [list(zip(*trees[r, c])) for c in model.classes]
            model.rounds.append([(np.array(f, np.int32), np.array(b, np.int32), np.array(x, np.int32), np.array(v)) for f, b, x, v in columns])
        return model

    def importance(self, spark) -> DataFrame:
        """(feature, splits, rank): how many splits use each feature."""
        used = np.bincount(np.concatenate([t[0][t[0] >= 0] for trees in self.rounds for t in trees] or [np.zeros(0, int)]), minlength=len(self.features))
        order = sorted(range(len(self.features)), key=lambda i: (-used[i], self.features[i]))
        return spark.createDataFrame([(self.features[i], int(used[i]), k + 1) for k, i in enumerate(order)], "feature string, splits long, rank int")


def _add(sums: np.ndarray, by_feature: np.ndarray, tree: tuple, nodes: list[int], g: np.ndarray, h: np.ndarray, n_bins: int) -> None:
    """Adds rows of (features, rows) bins to the (3, features, nodes and their bins) sums of gradients, second derivatives and rows."""
    to_slot = np.full(len(tree[0]), -1)
    to_slot[nodes] = np.arange(len(nodes))
    slot = to_slot[descend(tree, by_feature.T)]
    at = np.flatnonzero(slot >= 0)
    first, width, g, h = slot[at] * n_bins, len(nodes) * n_bins, g[at], h[at]
    # A feature at a time: its cells of all nodes stay in the processor's cache.
    for f, mine in enumerate(by_feature[:, at]):
        cell = first + mine
        sums[0, f] += np.bincount(cell, g, width)
        sums[1, f] += np.bincount(cell, h, width)
        sums[2, f] += np.bincount(cell, minlength=width)


def _histograms(state: DataFrame, rounds: list[list[tuple]], trees: list[tuple], wanted: list[list[int]], n_features: int, n_bins: int) -> DataFrame:
    """(tree, node, sums): gradients, second derivatives and rows of each feature and bin for the wanted nodes, packed, one row for each task."""
    n_classes = len(trees)
    factor = n_classes / max(n_classes - 1, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((3, n_features, len(nodes) * n_bins)) for nodes in wanted]
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(0).to_numpy()
            bins = _matrix(batch.column(1), np.uint8, n_features)
            p = softmax(_replayed(_matrix(batch.column(2), np.float64, n_classes), bins, rounds))
            by_feature = np.ascontiguousarray(bins.T)
            for k, nodes in enumerate(wanted):
                if nodes:
                    _add(sums[k], by_feature, trees[k], nodes, p[:, k] - (y == k), factor * p[:, k] * (1 - p[:, k]), n_bins)
        of_node = lambda k, s: sums[k][:, :, s * n_bins : (s + 1) * n_bins]
        found = [(k, node, of_node(k, s).tobytes()) for k, nodes in enumerate(wanted) for s, node in enumerate(nodes) if of_node(k, s)[2].any()]
        if found:
            tree, node, packed = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(node, pa.int32()), pa.array(packed, pa.binary())], ["tree", "node", "sums"])

    return state.select("y", "bins", "scores").mapInArrow(run, "tree int, node int, sums binary")


def best_split(sums: np.ndarray, s: Settings) -> tuple:
    """(gain, feature, bin, sums on the left, sums of the node) of the best split of a node's (3, features, bins) sums."""
    left = np.cumsum(sums, axis=2)
    whole = left[:, :, -1:]
    right = whole - left
    ok = (left[2] >= s.min_rows) & (right[2] >= s.min_rows) & (left[1] >= s.min_hessian) & (right[1] >= s.min_hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - whole[0] ** 2 / whole[1]
    gain = np.where(ok, np.round(gain, DIGITS), -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, b]), int(f), int(b), *map(float, left[:, f, b]), *map(float, whole[:, f, 0])


SPLIT = "gain double, feature int, bin int, gl double, hl double, nl double, g double, h double, n double"


def _best_splits(histograms: DataFrame, n_features: int, n_bins: int, s: Settings, tasks: int) -> DataFrame:
    """(tree, node, gain, feature, ...): the best split of each node; the rows of a node meet in one of so many tasks, which adds them as they come.

    With no tasks the histograms are of one task already and stay there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for key, packed in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2)):
                part = np.frombuffer(packed.as_buffer(), np.float64)
                total[key] = total[key] + part if key in total else part
        rows = [(*key, *best_split(x.reshape(3, n_features, n_bins), s)) for key, x in total.items()]
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    names = ["tree", "node", *(x.split()[0] for x in SPLIT.split(", "))]
    schema = pa.schema([(n, pa.int32() if n in ("tree", "node", "feature", "bin") else pa.float64()) for n in names])
    return (histograms.repartition(tasks, "tree", "node") if tasks else histograms).mapInArrow(run, f"tree int, node int, {SPLIT}")


def _taken(tree: Tree, leaves: int) -> list[int]:
    """Nodes that are split when splits are taken by known gain until there are ``leaves`` leaves."""
    heap = [(-tree.best[0][0], 0)] if 0 in tree.best else []
    out = []
    while heap and len(out) < leaves - 1:
        gain, node = heapq.heappop(heap)
        if -gain <= 0:
            break
        out.append(node)
        for child in (tree.left[node], tree.left[node] + 1):
            if tree.left[node] >= 0 and child in tree.best:
                heapq.heappush(heap, (-tree.best[child][0], child))
    return out


def _grow(state: DataFrame, rounds: list[list[tuple]], n_classes: int, n_features: int, s: Settings, by_class: bool = False) -> list[tuple]:
    """One tree for each class on the gradients at the replayed scores, by passes over dealt rows or in a task for each class."""
    if by_class:
        return _grow_by_class(state, rounds, n_classes, n_features, s)
    tasks = state.rdd.getNumPartitions()

    def ask(trees: list[Tree], wanted: list[list[int]]) -> list[tuple]:
        sums = _histograms(state, rounds, [t.arrays() for t in trees], wanted, n_features, s.bins + 1)
        meet = 0 if tasks == 1 else min(tasks, math.ceil(sum(map(len, wanted)) / NODES))
        return _best_splits(sums, n_features, s.bins + 1, s, meet).collect()

    return _grown(n_classes, ask, s)


def _grown(n_classes: int, ask, s: Settings) -> list[tuple]:
    """Trees grown from the best splits of wanted nodes, which ``ask`` finds."""
    trees = [Tree() for _ in range(n_classes)]
    for t in trees:
        t.add((0.0, 0.0, 0))
    wanted = [[0] for _ in trees]
    while any(wanted):
        for tree, node, gain, feature, cut, gl, hl, nl, g, h, n in ask(trees, wanted):
            t = trees[tree]
            t.sums[node] = (g, h, int(n))
            if gain > 0:
                t.best[node] = (gain, feature, cut, (gl, hl, int(nl)), (g - gl, h - hl, int(n - nl)))
        wanted = []
        for t in trees:
            fresh = []
            for node in _taken(t, s.leaves):
                if t.left[node] < 0:
                    _, t.feature[node], t.bin[node], left, right = t.best[node]
                    t.left[node] = t.add(left)
                    t.add(right)
                    # A child of too few rows for two leaves is known to stay one.
                    fresh += [c for c in (t.left[node], t.left[node] + 1) if t.sums[c][2] >= 2 * s.min_rows]
            wanted.append(fresh)
    return [_pruned(t, set(_taken(t, s.leaves)), s.rate) for t in trees]


def _grow_by_class(state: DataFrame, rounds: list[list[tuple]], n_classes: int, n_features: int, s: Settings) -> list[tuple]:
    """``_grow`` in one job: tasks make the gradients of their rows, and each class's task, which gets them all, grows its tree."""
    factor, n_bins = n_classes / max(n_classes - 1, 1), s.bins + 1

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(b for b in batches if b.num_rows):
            y, bins = batch.column(0).to_numpy(), _matrix(batch.column(1), np.uint8, n_features)
            p = softmax(_replayed(_matrix(batch.column(2), np.float64, n_classes), bins, rounds))
            g, h = p - (y[:, None] == np.arange(n_classes)), factor * p * (1 - p)
            packed = bins.T.tobytes()
            for c in range(n_classes):
                row = {"class": c, "part": part, "batch": k, "bins": packed, "g": g[:, c].tobytes(), "h": h[:, c].tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for row in (r for b in batches for r in b.to_pylist()):
            held.setdefault(row["class"], []).append((row["part"], row["batch"], *(np.frombuffer(row[x], kind) for x, kind in (("bins", np.uint8), ("g", np.float64), ("h", np.float64)))))
        for c, blocks in held.items():
            # In one order, whatever the order of arrival.
            blocks.sort(key=lambda b: b[:2])
            by_feature = np.concatenate([b[2].reshape(n_features, -1) for b in blocks], axis=1)
            g, h = (np.concatenate([b[k] for b in blocks]) for k in (3, 4))

            def ask(trees: list[Tree], wanted: list[list[int]]) -> Iterator[tuple]:
                sums = np.zeros((3, n_features, len(wanted[0]) * n_bins))
                _add(sums, by_feature, trees[0].arrays(), wanted[0], g, h, n_bins)
                for k, node in enumerate(wanted[0]):
                    yield 0, node, *best_split(sums[:, :, k * n_bins : (k + 1) * n_bins], s)

            feature, cut, left, value = (x.tolist() for x in _grown(1, ask, s)[0])
            yield pa.RecordBatch.from_pylist([{"class": c, "feature": feature, "bin": cut, "left": left, "value": value}], made)

    schema = pa.schema([("class", pa.int32()), ("part", pa.int32()), ("batch", pa.int32()), ("bins", pa.binary()), ("g", pa.binary()), ("h", pa.binary())])
    made = pa.schema([("class", pa.int32()), *((x, pa.list_(pa.int32())) for x in ("feature", "bin", "left")), ("value", pa.list_(pa.float64()))])
    blocks = state.select("y", "bins", "scores").mapInArrow(gradients, "class int, part int, batch int, bins binary, g binary, h binary")
    trees = blocks.repartitionById(n_classes, "class").mapInArrow(grow, "class int, feature array<int>, bin array<int>, left array<int>, value array<double>").collect()
    return [(*(np.array(r[x], np.int32) for x in ("feature", "bin", "left")), np.array(r["value"])) for r in sorted(trees, key=lambda r: r["class"])]


def _pruned(tree: Tree, split: set[int], rate: float) -> tuple[np.ndarray, ...]:
    """The tree of the splits that were taken at last, its leaves with their values."""
    out, todo = Tree(), [(0, -1, 0)]
    while todo:
        node, parent, side = todo.pop(0)
        at = out.add(tree.sums[node])
        if parent >= 0 and not side:
            out.left[parent] = at
        if node in split:
            out.feature[at], out.bin[at] = tree.feature[node], tree.bin[node]
            todo += [(tree.left[node], at, 0), (tree.left[node] + 1, at, 1)]
        else:
            g, h, _ = tree.sums[node]
            out.value[at] = -rate * g / h if h > 0 else 0.0
    return out.arrays()


def _tasks(size: int, slots: int) -> int:
    """Into how many parts rows of ``size`` bytes are dealt where ``slots`` tasks run at once: all slots are used unless parts get too small, and parts are of bounded size."""
    return max(1, math.ceil(size / TASK_BYTES), min(slots, math.ceil(size / LEAST_BYTES)))


def fit(rows: DataFrame, features: list[str], label: str, settings: Settings = Settings()) -> Boosted:
    """The model of the rows whose ``label`` is known."""
    known = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), *features)
    counts = sorted(map(tuple, known.groupBy("label").count().collect()))
    if not counts:
        raise ValueError("no row has a class")
    total = sum(n for _, n in counts)
    at = F.array(*[F.lit(k / settings.bins) for k in range(1, settings.bins)])
    # One scan for the borders of all features.
    quantiles = known.agg(*[F.percentile_approx(finite(F.col(f).cast("double")), at, F.lit(ACCURACY)).alias(f) for f in features]).first()
    model = Boosted(features, [sorted(set(quantiles[f] or [])) for f in features], [c for c, _ in counts], [float(np.log(n / total)) for _, n in counts])
    place = F.create_map(*[x for k, (c, _) in enumerate(counts) for x in (F.lit(c), F.lit(k))])
    first = F.lit(np.array(model.first).tobytes())
    size = total * (len(features) + 8 * len(counts))
    parts = _tasks(size, rows.sparkSession.sparkContext.defaultParallelism)
    state = staged(model.binned(known.withColumn("y", place[F.col("label")]), "y").withColumn("scores", first).repartition(parts), "boosting")
    if len(counts) == 1:
        return model
    for r in range(settings.rounds):
        trees = _grow(state, model.rounds[r - r % REPLAY :], len(counts), len(features), settings, size <= TASK_BYTES)
        if all(len(t[0]) == 1 for t in trees):
            # No class has a leaf that can still be split.
            break
        model.rounds.append(trees)
        if r % REPLAY == REPLAY - 1 and r + 1 < settings.rounds:
            state = staged(_with_scores(state, model.rounds[-REPLAY:], len(features)), "boosting")
    return model


def _with_scores(state: DataFrame, rounds: list[list[tuple]], n_features: int) -> DataFrame:
    n_classes = len(rounds[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = _replayed(_matrix(batch.column(2), np.float64, n_classes), _matrix(batch.column(1), np.uint8, n_features), rounds)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _packed(scores)], ["y", "bins", "scores"])

    return state.mapInArrow(run, "y int, bins binary, scores binary")
