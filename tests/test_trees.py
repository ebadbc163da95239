"""Packed trees: boosting gives MLlib's trees, the forest its method, and no trainer of MLlib sees the rows."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shopfloor.operators import learning as L
from shopfloor.operators import trees as T


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """Counts, zeros, a constant, a copy of the first feature; more rows than MLlib samples for its splits."""
    rng = np.random.default_rng(5)
    n = 15000
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 8, n), rng.exponential(size=n), np.zeros(n), rng.integers(0, 2, n)])
    x = np.column_stack([x, x[:, 0]])
    y = (x[:, 0] + x[:, 1] / 4 + rng.normal(size=n) > 1.5).astype(float)
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"]).repartition(3)
    path = str(tmp_path_factory.mktemp("trees") / "rows")
    df.write.parquet(path)
    return spark.read.parquet(path)


def scores(model, rows):
    return np.array([r.score for r in L.scored(model, rows, "m").select("score").collect()])


def test_boosting_gives_the_trees_of_mllib(rows, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 1000)
    theirs = GBTClassifier(maxIter=6, maxDepth=5, stepSize=0.1, seed=42).fit(rows)
    ours = L.boosting().setMaxIter(6).fit(rows)
    assert ours.getNumTrees == 6 and ours.totalNumNodes == theirs.totalNumNodes and ours.treeWeights == theirs.treeWeights
    assert np.allclose(scores(ours, rows), scores(theirs, rows), atol=1e-9)
    assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-6)


def test_forest_is_as_good_as_that_of_mllib(rows, tmp_path):
    theirs = RandomForestClassifier(numTrees=40, maxDepth=8, seed=42).fit(rows)
    ours = L.forest().setNumTrees(40).fit(rows)
    a, b = scores(ours, rows), scores(theirs, rows)
    assert ours.getNumTrees == 40 and abs(ours.totalNumNodes / theirs.totalNumNodes - 1) < 0.1
    assert abs(a - b).mean() < 0.03 and np.corrcoef(a, b)[0, 1] > 0.99
    x, y = ours.featureImportances.toArray(), theirs.featureImportances.toArray()
    assert abs(x[0] + x[5] - y[0] - y[5]) < 0.06 and x[3] == 0
    ours.write().save(str(tmp_path / "model"))
    assert np.array_equal(scores(type(ours).load(str(tmp_path / "model")), rows), a)
    assert np.array_equal(scores(L.forest().setNumTrees(40).fit(rows), rows), a)


def test_bootstrap_counts():
    w = T.bootstrap(200_000, 42, 3, 7)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert np.array_equal(w, T.bootstrap(200_000, 42, 3, 7)) and not np.array_equal(w, T.bootstrap(200_000, 42, 4, 7))


def test_no_trainer_of_mllib_gets_the_rows(rows, monkeypatch):
    seen = []
    for kind in (RandomForestClassifier, GBTClassifier):
        monkeypatch.setattr(kind, "_fit", lambda self, df, fit=kind._fit: seen.append(df.count()) or fit(self, df))
    L.forest().setNumTrees(2).fit(rows)
    L.boosting().setMaxIter(2).fit(rows)
    assert len(seen) == 2 and max(seen) <= 2


def test_odd_labels_go_to_mllib(rows):
    """Labels of one class, or more than two, are MLlib's to fit or refuse; a null label is refused."""
    one = L.forest().setNumTrees(3).fit(rows.withColumn("label", F.lit(0.0)))
    assert one.totalNumNodes == 3
    assert L.forest().setNumTrees(3).setMaxDepth(2).fit(rows.withColumn("label", F.rint(F.rand(1) * 2))).numClasses == 3
    with pytest.raises(Exception):
        L.boosting().fit(rows.withColumn("label", F.when(F.rand(1) < 0.9, F.col("label"))))
    with pytest.raises(Exception):
        L.boosting().fit(rows.where("label > 2"))
