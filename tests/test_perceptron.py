"""The perceptron over packed sequences: MLlib's weights, gradients against differences, packing, and no flattened copy of all rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shopfloor.operators import features as FE
from shopfloor.operators import learning as L
from shopfloor.operators import perceptron as P


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    sizes = [5, 4, 3, 2]
    theta, x, y, w = rng.normal(size=24 + 15 + 8), rng.normal(size=(7, 5)), rng.integers(0, 2, 7), rng.uniform(1, 3, 7)
    g, _ = P.gradient(sizes, theta, x, y, w)
    for i in range(len(theta)):
        e = np.zeros(len(theta))
        e[i] = 1e-6
        slope = (P.gradient(sizes, theta + e, x, y, w)[1] - P.gradient(sizes, theta - e, x, y, w)[1]) / 2e-6
        assert abs(g[i] - slope) < 1e-4 * max(1.0, abs(slope)), i


@pytest.fixture(scope="module")
def rows(spark):
    """The last position has no spread."""
    rng = np.random.default_rng(3)
    x = np.hstack((rng.normal(5, [1, 2, 30], size=(1024, 3)), np.full((1024, 1), 7.0)))
    y = (x[:, 0] * x[:, 1] + rng.normal(scale=2, size=1024) > 25).astype(float)
    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["raw", "label"]).coalesce(1).cache()


@pytest.mark.parametrize("iterations,n,partitions", [(1, 1024, 1), (12, 1024, 1), (12, 930, 4)])
def test_weights_are_those_of_mllib(spark, rows, iterations, n, partitions):
    rows = rows.limit(n).repartition(partitions).cache()  # of 930 rows, each partition ends with a smaller stack
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(rows)
    theirs = MultilayerPerceptronClassifier(layers=[4, 64, 32, 2], maxIter=iterations, seed=42, blockSize=128).fit(scaler.transform(rows))
    model = L.sequence_model(4, max_iter=iterations).fit(rows)
    ours = model.stages[-1]
    assert np.allclose(model.stages[0].mean.toArray(), scaler.mean.toArray()) and np.allclose(model.stages[0].std.toArray(), scaler.std.toArray())
    assert np.allclose(ours.weights.toArray(), theirs.weights.toArray(), atol=1e-6)
    a, b = ([r.score for r in L.scored(m, d, "m").collect()] for m, d in ((model, rows), (theirs, scaler.transform(rows))))
    assert np.allclose(a, b, atol=1e-6) and max(a) - min(a) > 0.01


def readings(spark, machines, each):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(f"m{m}", t, *map(float, rng.normal(size=2)), float(t % 3 == 0)) for m in range(machines) for t in range(each)],
                                 "machine_id string, ts int, a double, b double, label double")


def test_packed_sequences_keep_their_numbers(spark):
    seq = FE.sequences(readings(spark, 3, 400), ["ts"], ["a", "b"], "label", 12).select(F.flatten("sequence").alias("x"), "label")
    got = seq.orderBy(F.rand(1)).limit(200).toArrow().to_batches() + seq.toArrow().to_batches()
    whole = np.concatenate([b.column(0).flatten().to_numpy().reshape(b.num_rows, -1) for b in got])
    packed = list(P._pack(2, 2, 128)(iter(got)))
    back = [*P._blocks(iter(packed), 24)]
    assert np.array_equal(np.concatenate([x for x, _, _ in back]), whole)
    assert np.array_equal(np.concatenate([y for _, y, _ in back]), np.concatenate([b.column(1).to_numpy() for b in got]))
    n = len(whole)
    assert np.allclose(np.concatenate([w for _, _, w in back]), [1.0] * (n - n % 128) + [128 / (n % 128)] * (n % 128))
    run = list(P._pack(2, 2, 128)(iter(seq.toArrow().to_batches())))
    assert sum(len(c.as_py()) for b in run for c in b.column(0)) < 2 * 8 * 2 * 1200  # 24 numbers a row would be 223 KB


def test_odd_rows_are_refused():
    def batch(x, y):
        return iter([pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64())], names=["x", "y"])])
    assert not list(P._pack(2, 1, 128)(batch([], [])))
    for x, y in (([[1.0, np.nan]], [0.0]), ([[1.0, 2.0]], [2.0]), ([[1.0, 2.0]], [None]), ([None], [1.0])):
        with pytest.raises(ValueError):
            list(P._pack(2, 1, 128)(batch(x, y)))


def test_minimum_of_a_curved_valley():
    def cost(v):
        a, b = v
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])
    found, losses = P.minimize(cost, np.array([-1.2, 1.0]), 100, 1e-12)
    assert np.allclose(found, 1, atol=1e-4) and losses[-1] < 1e-8


def test_no_trainer_keeps_the_flattened_rows(spark, monkeypatch):
    """MLlib's trainer stores every row it is given flat; it may see a handful, never the training rows."""
    seen, fit = [], MultilayerPerceptronClassifier._fit
    monkeypatch.setattr(MultilayerPerceptronClassifier, "_fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    seq = L.sequence_vectors(FE.sequences(readings(spark, 4, 60), ["ts"], ["a", "b"], "label", 12))
    model = L.sequence_model(24, max_iter=2).fit(seq)
    assert model.stages[-1].numFeatures == 24 and L.scored(model, seq, "m").count() == 4 * 48
    assert max(seen) <= 2
