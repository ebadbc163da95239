"""A perceptron over flattened sequences, fitted by summed gradients.

MLlib's trainer keeps every flattened sequence while it fits (240 numbers, about 2 KB a row), in memory and then on disk. Here
sequences are stored once and packed: of consecutive sequences that overlap only the steps not seen yet are kept, so a reading is
stored about once and not once per step. Each evaluation reads the packed table: a task restores the sequences of one block, standardises
them and returns one summed gradient; Spark adds them up. Only weights and sums cross the driver, whatever the number of sequences.

The method is MLlib's: starting weights of its classifier for the seed, hidden sigmoid layers, softmax with cross entropy, L-BFGS with
ten corrections and its line search and stopping rules. As there, rows are taken in stacks of ``stack`` and every stack counts alike, so
rows of a partition's last, smaller stack weigh more. The result is MLlib's scaler and classifier with the fitted numbers, so scoring is MLlib's, too.

Defined results: without training rows, with a missing or unknown label or a number that is not finite the fit raises an error, like
MLlib's. A position without spread counts nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.session import materialize

#: Sequences per stored block and gradient.
BLOCK = 1024


class SearchFailed(ArithmeticError):
    """No step along the direction lowers the loss enough."""


def parts(sizes: list[int], theta: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights (inputs, outputs), bias) per layer: views of the flat vector in MLlib's order."""
    out, at = [], 0
    for d, k in zip(sizes, sizes[1:]):
        out.append((theta[at:at + d * k].reshape(d, k), theta[at + d * k:at + (d + 1) * k]))
        at += (d + 1) * k
    return out


def gradient(sizes: list[int], theta: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """(gradient, loss), both summed over the rows by weight."""
    layers, out, rows = parts(sizes, theta), np.zeros_like(theta), np.arange(len(x))
    seen = [x]
    for w, b in layers[:-1]:
        a = seen[-1] @ w
        a += b
        a *= 0.5
        np.tanh(a, out=a)  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        a += 1
        a *= 0.5
        seen.append(a)
    z = seen[-1] @ layers[-1][0] + layers[-1][1]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    loss, off = -float(weight @ z[rows, y]), np.exp(z)
    off[rows, y] -= 1
    off *= weight[:, None]
    for k in range(len(layers) - 1, -1, -1):
        gw, gb = parts(sizes, out)[k]
        gw += seen[k].T @ off
        gb += off.sum(axis=0)
        if k:
            off = off @ layers[k][0].T * seen[k] * (1 - seen[k])
    return out, loss


def _checked(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sequences, labels) in blocks."""
    for b in batches:
        if not b.num_rows:
            continue
        if b.column(0).null_count or b.column(1).null_count:
            raise ValueError("training rows must have a sequence and a label")
        x, y = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1), b.column(1).to_numpy()
        if not np.isfinite(x).all() or not np.isin(y, np.arange(classes)).all():
            raise ValueError(f"training rows must have finite numbers and labels from 0 to {classes - 1}")
        for i in range(0, b.num_rows, BLOCK):
            yield np.ascontiguousarray(x[i:i + BLOCK], dtype="<f8"), y[i:i + BLOCK]


def _packed(x: np.ndarray, y: np.ndarray, weight: np.ndarray, step: int) -> pa.RecordBatch:
    width, bits = x.shape[1], x.view("<i8")
    new = np.ones(len(x), bool)
    if 0 < step < width:
        new[1:] = (bits[1:, :-step] != bits[:-1, step:]).any(axis=1)
    start = np.cumsum(np.where(new, width, step)) - width
    numbers = x[new[:, None] | (np.arange(width) >= width - step)]
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (numbers, start.astype("<i4"), y.astype("i1"), weight.astype("<f8"))],
                                      names=["numbers", "start", "y", "weight"])


def _pack(classes: int, step: int, stack: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per block of sequences: their numbers, where each sequence starts in these, labels and weights. A sequence that
    goes on from the one before (all but its last step equal, bit by bit) adds its last step only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0  # blocks that the last stack may reach into
        for x, y in _checked(batches, classes):
            held.append((x, y))
            n += len(y)
            while sum(len(y) for _, y in held[1:]) >= stack:
                x, y = held.pop(0)
                yield _packed(x, y, np.ones(len(y)), step)
        left = sum(len(y) for _, y in held)
        for x, y in held:
            at = np.arange(left, left - len(y), -1)  # rows from here to the end
            yield _packed(x, y, np.where(at <= n % stack, stack / max(1, n % stack), 1.0), step)
            left -= len(y)
    return run


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sequences, labels, weights) of each block from ``_pack``."""
    for b in batches:
        for numbers, start, y, weight in zip(*(c.to_pylist() for c in b.columns)):
            every = np.lib.stride_tricks.sliding_window_view(np.frombuffer(numbers, "<f8"), width)
            yield every[np.frombuffer(start, "<i4")], np.frombuffer(y, "i1"), np.frombuffer(weight, "<f8")


def _sums(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["at", "v"])


def _spread(width: int):
    """Per task and position: rows, their mean and the sum of squares around it, merged block by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, around = 0, np.zeros(width), np.zeros(width)
        for x, _, _ in _blocks(batches, width):
            some = x.mean(axis=0)
            around += ((x - some) ** 2).sum(axis=0) + (some - mean) ** 2 * (n * len(x) / (n + len(x)))
            mean += (some - mean) * (len(x) / (n + len(x)))
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(np.full(width, float(n))), pa.array(mean),
                                              pa.array(around)], names=["at", "n", "mean", "around"])
    return run


def _evaluation(sizes: list[int], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta, mean, scale = shared.value
        total, loss, n = np.zeros_like(theta), 0.0, 0.0
        for x, y, weight in _blocks(batches, sizes[0]):
            x -= mean
            x *= scale
            g, some = gradient(sizes, theta, x, y, weight)
            total += g
            loss += some
            n += weight.sum()
        if n:
            yield _sums(np.concatenate((total, [loss, n])))
    return run


def _direction(g: np.ndarray, steps: list[np.ndarray], slopes: list[np.ndarray]) -> np.ndarray:
    """Downhill by the last steps and changes of slope (newest first): the two loops of L-BFGS."""
    d, used = g.copy(), []
    for s, q in zip(steps, slopes):
        rho = s @ q
        a = s @ d / rho if rho else np.nan
        if not np.isfinite(a):
            raise SearchFailed("no usable history")
        used.append((a, rho, s, q))
        d -= a * q
    if steps:
        if steps[0] @ slopes[0] < 0:
            raise SearchFailed("no usable history")
        d *= steps[0] @ slopes[0] / (slopes[0] @ slopes[0])
    for a, rho, s, q in reversed(used):
        d += (a - q @ d / rho) * s
    return -d


def _search(at: Callable[[float], tuple[float, float]], value: float, slope: float, first: float) -> float:
    """A step that meets the strong Wolfe conditions; ``at(t)`` is (loss, slope) there."""
    if slope > 0:
        raise SearchFailed("not a way down")

    def between(a, b):
        (lt, lv, ls), (rt, rv, rs) = (a, b) if a[0] <= b[0] else (b, a)
        d1 = ls + rs - 3 * (lv - rv) / (lt - rt)
        d2 = np.sqrt(max(0.0, d1 * d1 - ls * rs))
        t = rt - (rt - lt) * (rs + d2 - d1) / (rs - ls + 2 * d2)
        low, high = lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)
        return float(min(max(t, low), high)) if np.isfinite(t) else (low + high) / 2

    def zoom(low, high):
        for _ in range(10):
            t = between(low, high)
            c = (t, *at(t))
            if c[1] > value + 1e-4 * t * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= 0.9 * abs(slope):
                    return t
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise SearchFailed("zoom")

    t, low = first, (0.0, value, slope)
    for i in range(10):
        c = (t, *at(t))
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * slope or c[1] >= low[1] and i:
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(slope):
            return t
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise SearchFailed("search")


def minimize(cost: Callable[[np.ndarray], tuple[float, np.ndarray]], theta: np.ndarray, iterations: int, tol: float,
             corrections: int = 10) -> tuple[np.ndarray, list[float]]:
    """(weights, losses) by L-BFGS: ends after ``iterations``, when the loss is within ``tol`` of the first loss of the greatest of
    the last twenty, when the gradient vanishes, or when the search fails twice in a row (after the first time it forgets its steps)."""
    value, g = cost(theta)
    losses, steps, slopes, failed = [value], [], [], False
    done = 0
    while done < iterations:
        if np.linalg.norm(g) <= max(tol * abs(value), 1e-8) or len(losses) > 1 and abs(value - max(losses[-20:])) <= tol * abs(losses[0]):
            break
        last = {}
        try:
            d = _direction(g, steps, slopes)

            def along(t):
                last[t] = cost(theta + t * d)
                return last[t][0], float(last[t][1] @ d)
            t = _search(along, value, float(g @ d), 1.0 if done else 1 / np.linalg.norm(d))
            if t * np.linalg.norm(g) < 1e-10:
                raise SearchFailed("step too small")
        except SearchFailed:
            if failed:
                break
            steps, slopes, failed = [], [], True
            continue
        failed = False
        was, (value, g) = g, last[t]
        theta = theta + t * d
        steps, slopes = [t * d, *steps][:corrections], [g - was, *slopes][:corrections]
        losses.append(value)
        done += 1
    return theta, losses


class SequencePerceptron(Estimator):
    """Fits on rows (raw: vector, label). ``step``: numbers per step of a sequence, for packing (0: sequences are stored whole)."""

    def __init__(self, layers: list[int], step: int = 0, seed: int = 42, max_iter: int = 50, tol: float = 1e-6,
                 stack: int = 128):
        super().__init__()
        self.layers, self.step, self.seed, self.max_iter, self.tol, self.stack = list(layers), step, seed, max_iter, tol, stack

    def _fit(self, train: DataFrame) -> PipelineModel:
        spark, sizes = train.sparkSession, self.layers
        rows = train.select(vector_to_array("raw").alias("x"), F.col("label").cast("double").alias("y"))
        data = materialize(rows.mapInArrow(_pack(sizes[-1], self.step, self.stack), "numbers binary, start binary, y binary, weight binary"), "packed-sequences")
        some = materialize(data.mapInArrow(_spread(sizes[0]), "at int, n double, mean double, around double"), "sequence-spread")
        means = some.groupBy("at").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all_mean"))
        around = F.col("around") + F.col("n") * (F.col("mean") - F.col("all_mean")) ** 2
        spread = some.join(means, "at").groupBy("at").agg(F.first("all_mean").alias("mean"), F.sum(around).alias("around"), F.sum("n").alias("n")) \
            .orderBy("at").collect()
        if not spread:  # one row per position
            raise ValueError("no training sequences")
        mean = np.array([r["mean"] for r in spread])
        dev = np.array([np.sqrt(r["around"] / (r["n"] - 1)) if r["n"] > 1 else 0.0 for r in spread])
        scale = np.divide(1.0, dev, out=np.zeros_like(dev), where=dev > 0)

        def cost(theta):
            shared = spark.sparkContext.broadcast((theta, mean, scale))
            sums = data.mapInArrow(_evaluation(sizes, shared), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
            total = np.zeros(len(theta) + 2)  # one row per weight
            for r in sums:
                total[r["at"]] = r["v"]
            shared.unpersist()
            return float(total[-2] / total[-1]), total[:-2] / total[-1]

        # Two rows whose mean and deviation are those of the training rows: MLlib's own scaler and classifier hold the fitted numbers.
        two = spark.createDataFrame([(Vectors.dense(mean + s * dev / np.sqrt(2)), float(s > 0)) for s in (-1, 1)], ["raw", "label"])
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(two)
        mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=sizes, maxIter=0, seed=self.seed)
        start = mlp.fit(scaler.transform(two)).weights.toArray()
        theta, self.losses = minimize(cost, start, self.max_iter, self.tol)
        return PipelineModel([scaler, mlp.setInitialWeights(Vectors.dense(theta)).fit(scaler.transform(two))])
