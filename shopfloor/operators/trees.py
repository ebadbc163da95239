"""Forests and boosted trees fitted by summed histograms over packed rows.

MLlib's trainers keep an object per row and touch the statistics of all trees at once, row by row. Here the rows are binned once
and stored, a byte per feature, in blocks of ``BLOCK`` rows. For each level of the trees a task sends its blocks down the splits
found so far, tree by tree, and adds one histogram per open node; the histograms are summed and the best splits are taken from the
sums. Only splits cross the driver, whatever the number of rows.

The method is MLlib's: split candidates from its sample (same rows, same rule), Gini or variance gain, its stopping rules, the first of equal
gains, leaves merged when they predict alike, Poisson bootstrap weights and a draw of features per node for the forest, residuals of the
log loss for boosting. The forest's draws are made per tree and block by a generator of their own, so its trees are not
MLlib's tree for tree; boosting draws nothing and gives MLlib's trees, but for splits whose gains are equal up to rounding. The result is MLlib's model with the fitted nodes, so scoring, saving
and importances are MLlib's, too.

Params that change the method (other impurities, subsampling, thresholds on instances, weights, a validation column, categorical features) and labels that are not
0 and 1 go to MLlib's trainer.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.session import checkpoint_dir, materialize

#: Rows per stored block: their bins stay in a core's cache.
BLOCK = 1 << 15
EPSILON = 2.0 ** -52


# --- split candidates ------------------------------------------------------------------------

def candidates(values: np.ndarray, expected: float, most: int) -> np.ndarray:
    """Thresholds of one feature from its sampled values, as MLlib places them: zeros are counted as what the
    expected size of the sample leaves; up to ``most`` thresholds at even strides of the counts, between neighbouring values."""
    seen, counts = np.unique(values[values != 0], return_counts=True)
    zeros, counts = expected - counts.sum(), counts.astype(float)
    if zeros > EPSILON * max(1, len(values)) * 100:
        at = int(np.searchsorted(seen, 0.0))
        seen, counts = np.insert(seen, at, 0.0), np.insert(counts, at, zeros)
    if len(seen) - 1 <= most:
        return (seen[:-1] + seen[1:]) / 2
    stride = expected / (most + 1)
    out, now, target = [], counts[0], stride
    for i in range(1, len(seen)):
        before, now = now, now + counts[i]
        if abs(before - target) < abs(now - target):
            out.append((seen[i - 1] + seen[i]) / 2)
            target += stride
    return np.array(out)


def sampled_candidates(rows: DataFrame, n: int, bins: int, seed: int) -> list[np.ndarray]:
    """Per feature its thresholds, from the rows that MLlib's trainer samples (about 10,000, at random over all partitions)."""
    spark = rows.sparkSession
    need = max(bins * bins, 10000)
    share = need / n if need < n else 1.0
    jvm, some = spark.sparkContext._jvm, rows.select("features")
    if share < 1:
        drawn = some._jdf.toJavaRDD().sample(False, share, jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt())
        some = DataFrame(spark._jsparkSession.createDataFrame(drawn, some._jdf.schema()), spark)
    x = np.array([r[0].toArray() for r in some.collect()])
    if not np.isfinite(x).all():
        raise ValueError("training rows must have finite numbers")
    return [candidates(x[:, f], share * n, min(bins, n) - 1) for f in range(x.shape[1])]


# --- packed rows -----------------------------------------------------------------------------

def _pack(thresholds: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per block: its number, the bins of its rows (a byte each, row by row) and the labels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        first, made = TaskContext.get().partitionId() << 32, 0
        x, y, n = [], [], 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), pa.array([np.concatenate(x).tobytes()], pa.binary()),
                                               pa.array([np.concatenate(y).tobytes()], pa.binary())], names=["block", "x", "y"])
        for b in batches:
            values = b.column(0).flatten().to_numpy().reshape(b.num_rows, len(thresholds))
            labels = b.column(1).to_numpy()
            if not np.isfinite(values).all():
                raise ValueError("training rows must have finite numbers")
            for i in range(0, b.num_rows, BLOCK):
                some = values[i:i + BLOCK]
                if n and n + len(some) > BLOCK:
                    yield block()
                    x, y, n, made = [], [], 0, made + 1
                x.append(np.stack([np.searchsorted(t, some[:, f]) for f, t in enumerate(thresholds)], axis=1).astype(np.uint8))
                y.append(labels[i:i + BLOCK].astype(np.uint8))
                n += len(some)
        if n:
            yield block()
    return run


def packed(rows: DataFrame, thresholds: list[np.ndarray]) -> DataFrame:
    return materialize(rows.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
                       .mapInArrow(_pack(thresholds), "block long, x binary, y binary"), "binned-rows")


def _blocks(data: DataFrame) -> RDD:
    """(number, bins, labels) of the stored blocks, in a few tasks per core: each task returns its histograms."""
    return data.coalesce(2 * data.sparkSession.sparkContext.defaultParallelism).rdd.map(lambda r: (r[0], bytes(r[1]), bytes(r[2])))


# --- trees as arrays -------------------------------------------------------------------------

class Tree:
    """Nodes in a heap (children of i at 2 i + 1 and 2 i + 2): feature and bin of the split (bins up to it go left; -1: none),
    impurity, gain and statistics."""

    def __init__(self, depth: int, stats: int):
        n = (2 << depth) - 1
        self.feature, self.bin = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        self.gain, self.impurity, self.stats = np.full(n, -1.0), np.zeros(n), np.zeros((n, stats))
        self.open = [0]

    def routes(self) -> tuple[np.ndarray, np.ndarray]:
        """(feature or -1, bin) per node, as far as the tree goes."""
        return self.feature, self.bin


def descend(x: np.ndarray, width: int, rows: np.ndarray, routes: tuple[np.ndarray, np.ndarray], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their nodes) after ``steps`` splits, of the rows that have not ended in a leaf before; ``x``: the block's bins, flat."""
    feature, upto = routes
    node, base = np.zeros(len(rows), np.int64), rows * width
    for _ in range(steps):
        f = feature.take(node)
        if (f < 0).any():
            on = np.flatnonzero(f >= 0)
            rows, node, base, f = rows[on], node[on], base[on], f[on]
        right = x.take(base + f) > upto.take(node)
        node *= 2
        node += 1
        node += right
    return rows, node


def leaf_values(x: np.ndarray, width: int, n: int, routes: tuple[np.ndarray, np.ndarray], values: np.ndarray) -> np.ndarray:
    feature, upto = routes
    node, base = np.zeros(n, np.int64), np.arange(n) * width
    while True:
        f = feature.take(node)
        inner = f >= 0
        if not inner.any():
            return values.take(node)
        right = x.take(base + np.maximum(f, 0)) > upto.take(node)
        node = np.where(inner, 2 * node + 1 + right, node)


def gini(s: np.ndarray) -> np.ndarray:
    """Impurity of class counts in the last axis."""
    n = s.sum(axis=-1)
    share = s / np.where(n > 0, n, 1)[..., None]
    return np.where(n > 0, 1 - (share * share).sum(axis=-1), 0.0)


def variance(s: np.ndarray) -> np.ndarray:
    """Impurity of (count, sum, sum of squares) in the last axis."""
    n = np.where(s[..., 0] > 0, s[..., 0], 1)
    return np.where(s[..., 0] > 0, (s[..., 2] - s[..., 1] * s[..., 1] / n) / n, 0.0)


def best_splits(hist: np.ndarray, features: np.ndarray, n_splits: np.ndarray, impurity, size) -> list[tuple]:
    """Per open node (feature or -1, bin, gain, own, left, right statistics) of a histogram (nodes, drawn features, bins, statistics)."""
    upto = hist.cumsum(axis=2)
    total = upto[:, :, -1:, :]
    left, right = upto[:, :, :-1, :], total - upto[:, :, :-1, :]
    own, n, nl, nr = impurity(total[:, :, 0, :])[:, :, None], size(total), size(left), size(right)
    n = np.where(n > 0, n, 1)
    gain = own - nl / n * impurity(left) - nr / n * impurity(right)
    bins = np.arange(hist.shape[2] - 1)
    ok = (bins[None, None, :] < n_splits[features][:, :, None]) & (nl >= 1) & (nr >= 1) & (gain >= 0)
    gain = np.where(ok, gain, -1.0)
    out = []
    for i in range(len(hist)):
        flat = int(gain[i].argmax())
        j, b = divmod(flat, gain.shape[2])
        g = float(gain[i, j, b])
        out.append((int(features[i, j]) if g > 0 else -1, b, g, total[i, j, 0], left[i, j, b], right[i, j, b]))
    return out


def grow(tree: Tree, found: list[tuple], level: int, depth: int, impurity) -> None:
    """Takes the best splits of the open nodes and opens the children that can be split."""
    opened = []
    for node, (f, b, g, own, left, right) in zip(tree.open, found, strict=True):
        tree.stats[node], tree.impurity[node] = own, impurity(own)
        if f < 0:
            continue
        tree.feature[node], tree.bin[node], tree.gain[node] = f, b, g
        for child, s in ((2 * node + 1, left), (2 * node + 2, right)):
            tree.stats[child], tree.impurity[child] = s, impurity(s)
            if level + 1 < depth and abs(tree.impurity[child]) >= EPSILON:
                opened.append(child)
    tree.open = opened


# --- forest ----------------------------------------------------------------------------------

def _poisson_limits() -> np.ndarray:
    """Where a 32-bit number passes the next count of a Poisson draw with mean 1."""
    upto, p, out = 0.0, math.exp(-1), []
    for k in range(1, 14):
        upto += p
        out.append(min(2 ** 32 - 1, round(upto * 2 ** 32)))
        p /= k
    return np.array(out, np.uint32)


LIMITS = _poisson_limits()


def bootstrap(n: int, *key: int) -> np.ndarray:
    """Poisson counts with mean 1 of ``n`` rows, the same for the same key."""
    u = np.frombuffer(np.random.Generator(np.random.SFC64(np.random.SeedSequence(key))).bytes(4 * n), np.uint32)
    out = np.zeros(n, np.uint8)
    for limit in LIMITS:
        out += u >= limit
    return out


def _forest_histograms(shared, width: int, bins: int, level: int, seed: int):
    """(tree, histogram of its open nodes: node, drawn feature, bin, class) of a task's blocks."""
    def run(blocks: Iterable[tuple[int, bytes, bytes]]) -> Iterator[tuple[int, np.ndarray]]:
        plans, sums = shared.value, {}  # tree -> (routes, slot of each node, drawn features)
        for number, x, y in blocks:
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            for t, (routes, slot, drawn) in plans.items():
                weight = bootstrap(len(y), seed, t, number)
                rows, node = descend(x, width, np.flatnonzero(weight), routes, level)
                if level:
                    at = slot.take(node)
                    on = np.flatnonzero(at >= 0)
                    rows, at = rows[on], at[on]
                else:
                    at = node
                k = drawn.shape[1]
                values = x.take((rows * width)[:, None] + drawn.take(at, axis=0)).astype(np.int64)
                values *= 2
                values += (at * (k * bins * 2) + y.take(rows))[:, None]
                values += np.arange(k) * (bins * 2)
                some = np.bincount(values.ravel(), np.repeat(weight.take(rows).astype(float), k), minlength=len(drawn) * k * bins * 2)
                if t in sums:
                    sums[t] += some
                else:
                    sums[t] = some
        yield from ((t, s.astype(np.int64)) for t, s in sums.items())
    return run


def fit_forest(data: DataFrame, thresholds: list[np.ndarray], trees: int, depth: int, drawn: int, seed: int) -> list[Tree]:
    sc, width = data.sparkSession.sparkContext, len(thresholds)
    n_splits = np.array([len(t) for t in thresholds])
    bins, rng = max(2, int(n_splits.max()) + 1), np.random.default_rng(seed)
    grown = [Tree(depth, 2) for _ in range(trees)]
    blocks = _blocks(data)
    for level in range(depth):
        plans = {}
        for t, tree in enumerate(grown):
            if tree.open:
                slot = np.full(len(tree.feature), -1, np.int64)
                slot[tree.open] = np.arange(len(tree.open))
                chosen = np.stack([rng.permutation(width)[:drawn] for _ in tree.open])
                plans[t] = (tree.routes(), slot, chosen)
        if not plans:
            break
        shared = sc.broadcast(plans)

        def split(t, hist, shared=shared):
            chosen = shared.value[t][2]
            return best_splits(hist.reshape(*chosen.shape, bins, 2).astype(float), chosen, n_splits, gini, lambda s: s.sum(axis=-1))
        sums = blocks.mapPartitions(_forest_histograms(shared, width, bins, level, seed)).reduceByKey(np.add, sc.defaultParallelism)
        for t, found in sums.map(lambda kv: (kv[0], split(*kv))).collect():  # a split per open node
            grow(grown[t], found, level, depth, gini)
        shared.unpersist()
    return grown


# --- boosting --------------------------------------------------------------------------------

def _residual(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Downhill of the log loss for labels -1 and 1."""
    return 4.0 * y / (1.0 + np.exp(2.0 * y * f))


def _first(block: tuple[int, bytes, bytes]) -> tuple[bytes, bytes, bytes, bytes]:
    """(bins, labels, score so far, residual): the first tree is fitted to the labels -1 and 1."""
    _, x, y = block
    sign = np.frombuffer(y, np.uint8) * 2.0 - 1
    return x, y, np.zeros(len(sign)).tobytes(), sign.tobytes()


def _next(shared, width: int):
    def run(block: tuple[bytes, bytes, bytes, bytes]) -> tuple[bytes, bytes, bytes, bytes]:
        x, y, f, _ = block
        routes, values = shared.value
        sign = np.frombuffer(y, np.uint8) * 2.0 - 1
        score = np.frombuffer(f) + leaf_values(np.frombuffer(x, np.uint8), width, len(sign), routes, values)
        return x, y, score.tobytes(), _residual(score, sign).tobytes()
    return run


def _boost_histograms(shared, width: int, bins: int, level: int):
    """One array per task: histogram (node, feature, bin, statistic) of its blocks' residuals."""
    def run(blocks: Iterable[tuple[bytes, bytes, bytes, bytes]]) -> Iterator[np.ndarray]:
        routes, slot, nodes = shared.value
        size, total = nodes * bins, None
        for x, _, _, r in blocks:
            x, r = np.frombuffer(x, np.uint8), np.frombuffer(r)
            rows, node = descend(x, width, np.arange(len(r)), routes, level)
            at = slot.take(node)
            table = x.reshape(-1, width)
            if len(rows) < len(r) or (at < 0).any():
                on = np.flatnonzero(at >= 0)
                rows, at = rows[on], at[on]
                table, r = table[rows], r[rows]
            at, square, some = at * bins, r * r, np.empty((3, width, size))
            for f, column in enumerate(np.ascontiguousarray(table.T)):
                key = at + column
                some[0, f] = np.bincount(key, minlength=size)
                some[1, f] = np.bincount(key, r, size)
                some[2, f] = np.bincount(key, square, size)
            total = some if total is None else total + some
        if total is not None:
            yield total
    return run


def fit_boosting(data: DataFrame, thresholds: list[np.ndarray], rounds: int, rate: float, depth: int) -> list[Tree]:
    sc, width = data.sparkSession.sparkContext, len(thresholds)
    n_splits = np.array([len(t) for t in thresholds])
    bins, grown = max(2, int(n_splits.max()) + 1), []
    state = _blocks(data).map(_first).persist(StorageLevel.MEMORY_AND_DISK)
    held = []  # scores of earlier rounds and what they were made with, until the next are stored
    for m in range(rounds):
        tree = Tree(depth, 3)
        for level in range(depth):
            if not tree.open:
                break
            slot = np.full(len(tree.feature), -1, np.int64)
            slot[tree.open] = np.arange(len(tree.open))
            shared = sc.broadcast((tree.routes(), slot, len(tree.open)))
            hist = sum(state.mapPartitions(_boost_histograms(shared, width, bins, level)).collect())  # an array per task
            shared.unpersist()
            while held:
                held.pop().unpersist()
            hist = hist.reshape(3, width, len(tree.open), bins).transpose(2, 1, 3, 0)
            every = np.tile(np.arange(width), (len(tree.open), 1))
            grow(tree, best_splits(hist, every, n_splits, variance, lambda s: s[..., 0]), level, depth, variance)
        grown.append(tree)
        if m + 1 < rounds:
            values = (rate if m else 1.0) * tree.stats[:, 1] / np.maximum(tree.stats[:, 0], 1)
            step = sc.broadcast((tree.routes(), values))
            held.append(state)
            state = state.map(_next(step, width)).persist(StorageLevel.MEMORY_AND_DISK)
    for x in (*held, state):
        x.unpersist()
    return grown


# --- MLlib's models --------------------------------------------------------------------------

def node_rows(tree: Tree, thresholds: list[np.ndarray], predict) -> list[tuple]:
    """MLlib's stored nodes, numbered from the root, left before right; leaves that predict alike are merged."""
    def prune(i: int):
        if tree.feature[i] < 0:
            return (i, None, None)
        left, right = prune(2 * i + 1), prune(2 * i + 2)
        if left[1] is None and right[1] is None and predict(tree.stats[left[0]]) == predict(tree.stats[right[0]]):
            return (i, None, None)
        return (i, left, right)

    out = []

    def put(node) -> int:
        i, left, right = node
        at = len(out)
        out.append(None)
        s = tree.stats[i]
        own = (at, predict(s), float(tree.impurity[i]), [float(v) for v in s], int(s[0] if len(s) == 3 else s.sum()))
        if left is None:
            out[at] = (*own, -1.0, -1, -1, (-1, [], -1))
        else:
            a, b = put(left), put(right)
            f = int(tree.feature[i])
            out[at] = (*own, float(tree.gain[i]), a, b, (f, [float(thresholds[f][tree.bin[i]])], -1))
        return at
    put(prune(0))
    return out


def as_model(kind, like, count: str, trees: list[list[tuple]], weights: list[float], features: int):
    """MLlib's model with ``trees``, read from its stored form; ``like``: a model of one tree that gives the params, ``count`` the name
    of the one that holds the number of trees."""
    spark = SparkSession.active()
    at = checkpoint_dir(spark, "fitted-trees")
    like.write().save(f"{at}/like")
    about = json.loads(spark.read.text(f"{at}/like/metadata").first()[0])
    about["paramMap"][count], about["numTrees"], about["numFeatures"] = len(trees), len(trees), features
    of_tree, nodes = spark.read.parquet(f"{at}/like/treesMetadata"), spark.read.parquet(f"{at}/like/data").schema
    text = json.loads(of_tree.first()[1])
    named = [json.dumps(text | {"uid": f"{text['uid']}-{uuid.uuid4().hex[:12]}"}) for _ in trees]
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{at}/model/metadata")
    spark.createDataFrame([*zip(range(len(trees)), named, weights)], of_tree.schema).coalesce(1).write.parquet(f"{at}/model/treesMetadata")
    spark.createDataFrame([(t, row) for t, rows in enumerate(trees) for row in rows], nodes).coalesce(1).write.parquet(f"{at}/model/data")
    return kind.load(f"{at}/model")


class _Packed:
    """What both trainers share: the rows they take, binned and stored."""

    def _common(self) -> dict:
        return {"minInstancesPerNode": 1, "minInfoGain": 0.0, "minWeightFractionPerNode": 0.0, "subsamplingRate": 1.0}

    def _usual(self, rows: DataFrame, params: dict) -> bool:
        """The params are those that the packed trainers know and no feature is categorical."""
        kinds = rows.schema[self.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
        return all(self.getOrDefault(k) == v for k, v in params.items()) and not self.isDefined("weightCol") \
            and not {"nominal", "binary"} & set(kinds) and 0 < self.getMaxDepth() <= 12 and self.getMaxBins() <= 256

    def _rows(self, dataset: DataFrame, least_classes: int) -> tuple[DataFrame, int] | None:
        """(features, label) and their number, or None if there are none, or labels other than 0 and 1."""
        rows = dataset.select(F.col(self.getFeaturesCol()).alias("features"), F.col(self.getLabelCol()).cast("double").alias("label"))
        n, known, most = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("label").isin(0.0, 1.0), 1)), F.max("label")).first()
        return (rows, n) if n and known == n and most >= least_classes - 1 else None

    def _like(self, trainer, width: int, **one):
        two = [(Vectors.dense([0.0] * width), float(k)) for k in range(2)]
        rows = SparkSession.active().createDataFrame(two, [self.getFeaturesCol(), self.getLabelCol()])
        return trainer._fit(self.copy({self.getParam(k): v for k, v in one.items()}), rows)


class PackedForest(_Packed, RandomForestClassifier):
    """MLlib's forest classifier with the packed trainer."""

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        usual = self._usual(dataset, self._common() | {"impurity": "gini", "featureSubsetStrategy": "auto", "bootstrap": True})
        if not usual or self.getNumTrees() < 2 or (found := self._rows(dataset, 2)) is None:
            return super()._fit(dataset)
        rows, n = found
        at = sampled_candidates(rows, n, self.getMaxBins(), self.getSeed())
        trees = fit_forest(packed(rows, at), at, self.getNumTrees(), self.getMaxDepth(), math.ceil(math.sqrt(len(at))), self.getSeed())
        return as_model(RandomForestClassificationModel, self._like(RandomForestClassifier, len(at), numTrees=1), "numTrees",
                        [node_rows(t, at, lambda s: float(s.argmax())) for t in trees], [1.0] * len(trees), len(at))


class PackedBoosting(_Packed, GBTClassifier):
    """MLlib's boosted trees with the packed trainer."""

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        usual = self._usual(dataset, self._common() | {"impurity": "variance", "featureSubsetStrategy": "all", "lossType": "logistic"})
        if not usual or self.isDefined("validationIndicatorCol") or (found := self._rows(dataset, 1)) is None:
            return super()._fit(dataset)
        rows, n = found
        at = sampled_candidates(rows, n, self.getMaxBins(), self.getSeed())
        trees = fit_boosting(packed(rows, at), at, self.getMaxIter(), self.getStepSize(), self.getMaxDepth())
        return as_model(GBTClassificationModel, self._like(GBTClassifier, len(at), maxIter=1), "maxIter",
                        [node_rows(t, at, lambda s: float(s[1] / s[0])) for t in trees],
                        [1.0] + [self.getStepSize()] * (len(trees) - 1), len(at))
