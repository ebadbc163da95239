"""Failure models with MLlib: assemble features, fit forest / boosting / sequence
models on the positional train split, score val/test, evaluate per (model, split)
with the distributed metric aggregates, read importances.

Fitted models are kept in the driver process by model name and a fingerprint of the training
rows, so several reports over one model do not retrain it and changed data does.
"""

from __future__ import annotations

import functools

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.operators import evaluation as EV
from shopfloor.operators.perceptron import SequencePerceptron
from shopfloor.operators.trees import PackedBoosting, PackedForest
from shopfloor.session import materialize

_MODELS: dict = {}


def forest(seed: int = 42) -> RandomForestClassifier:
    return PackedForest(featuresCol="features", labelCol="label", numTrees=100, maxDepth=8, seed=seed)


def boosting(seed: int = 42) -> GBTClassifier:
    return PackedBoosting(featuresCol="features", labelCol="label", maxIter=100, stepSize=0.1, maxDepth=5,
                          seed=seed)


def pipeline(features: list[str], estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error"),
                            estimator])


def with_label(df: DataFrame, label: str = "is_failure") -> DataFrame:
    return df.withColumn("label", F.col(label).cast("double"))


def fit_cached(name: str, build, train: DataFrame, source: DataFrame | None = None) -> PipelineModel:
    """``source``: stored rows that ``train`` is built from, where these are cheaper to read."""
    rows = train if source is None else source
    stamp = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)]).cast("decimal(38,0)")
    seen = rows.agg(F.count(F.lit(1)), F.sum(stamp)).first()
    if (name, *seen) not in _MODELS:
        _MODELS[(name, *seen)] = build().fit(train)
    return _MODELS[(name, *seen)]


def scored(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """+ prediction (0/1) and score = probability of class 1."""
    out = model.transform(df)
    return out.withColumn("score", vector_to_array("probability")[1]) \
        .withColumn("pred", F.col("prediction").cast("int")).withColumn("model", F.lit(name))


def evaluate(pred: DataFrame, group: list[str]) -> DataFrame:
    """precision, recall, f1 (4 dp), roc_auc (4 dp) per group, in two aggregates. Rows are scored once and stored."""
    p = materialize(pred.select(*group, F.col("label").cast("int").alias("y"), "pred", "score"), "scored-rows")
    prf = EV.prf1(EV.confusion(p, group), group)
    auc = EV.roc_auc(p, group).select(*group, F.round("roc_auc", 4).alias("roc_auc"))
    return prf.join(auc, group, "left")


def importances(spark: SparkSession, model: PipelineModel, features: list[str]) -> DataFrame:
    """(feature, importance) from the fitted trees (a vector of len(features) numbers)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, [float(x) for x in imp])), "feature string, importance double")


def fallback_importances(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(feature, importance) for a model without importances: absolute correlation with the label,
    normalised to sum 1, in one aggregate; a constant feature counts nothing."""
    def strength(f):
        return F.coalesce(F.abs(F.nanvl(F.corr(f, label), F.lit(0.0))), F.lit(0.0))

    row = df.agg(*[strength(f).alias(f) for f in features])
    total = functools.reduce(lambda x, y: x + y, [F.col(f) for f in features])
    return row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), (
        F.col(f) / F.nullif(total, F.lit(0.0))).alias("importance")) for f in features])))


def sequence_vectors(seq: DataFrame) -> DataFrame:
    """Flatten (12 x F) sequences into one vector column."""
    flat = F.flatten("sequence")
    return seq.withColumn("raw", array_to_vector(flat))


def sequence_model(n_inputs: int, seed: int = 42, max_iter: int = 50, step: int = 0) -> Estimator:
    """Perceptron over standardised flattened sequences of ``n_inputs`` numbers, ``step`` of them per step."""
    return SequencePerceptron([n_inputs, 64, 32, 2], step=step, seed=seed, max_iter=max_iter, stack=128)
