"""Registered queries for the failure models. Trained-model outputs cannot equal an
independent SQL computation, so these run with the rows-only check; the metric
aggregates themselves are oracle-checked in q_rules (a_prf1, a_roc_auc, a_confusion)."""

from __future__ import annotations

import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from shopfloor.functions import constants as K
from shopfloor.operators import cleaning
from shopfloor.operators import features as FE
from shopfloor.operators import learning as L
from shopfloor.plans import q_decisions
from shopfloor.plans import sqltext as S
from shopfloor.plans.q_telemetry import featured, keyed_telemetry
from shopfloor.plans.registry import register, round_doubles
from shopfloor.session import checkpoint_dir, materialize
from shopfloor.sources import bindings as B
from shopfloor.sources import files as FS

FEATURES = FE.feature_names()
ORDER = ["ts", "machine_id", "k1", "k2", "k3"]


def split_frame(spark, sf_dir):
    """The feature rows with label and split, stored: fits and scorings read them many times, and each reading
    of the plan itself would clean, shuffle and sort the telemetry again."""
    return materialize(_split(spark, sf_dir).select(*ORDER, *FEATURES, "label", "split"), "split-rows")


def train_frame(spark, sf_dir):
    """The training rows alone, stored without their keys: what a fit needs that scores nothing."""
    train = _split(spark, sf_dir).where(F.col("split") == "train")
    return materialize(train.select(*FEATURES, "label", "split"), "train-rows")


def _split(spark, sf_dir):
    return L.with_label(FE.with_split(featured(spark, sf_dir), ORDER, keys=keyed_telemetry(spark, sf_dir)))


def _model(spark, sf_dir, name, data=None):
    data = split_frame(spark, sf_dir) if data is None else data
    train = data.where(F.col("split") == "train")
    build = {"RandomForest": lambda: L.pipeline(FEATURES, L.forest()),
             "GradientBoosting": lambda: L.pipeline(FEATURES, L.boosting())}[name]
    return L.fit_cached(name, build, train, train.select(*FEATURES, "label")), data


def _scored(spark, sf_dir, name, data=None):
    model, data = _model(spark, sf_dir, name, data)
    return L.scored(model, data.where(F.col("split") != "train"), name)


@register("m_assemble")
def q_assemble(spark, sf_dir):
    """Feature matrix: one 20-wide vector per reading, by split."""
    from pyspark.ml.feature import VectorAssembler
    v = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="error").transform(
        split_frame(spark, sf_dir))
    from pyspark.ml.functions import vector_to_array
    return v.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.max(F.size(vector_to_array("features"))).alias("n_features"))


@register("m_rf")
def q_rf(spark, sf_dir):
    """Forest (100 trees, depth 8, seed 42): validation and test metrics."""
    return L.evaluate(_scored(spark, sf_dir, "RandomForest"), ["model", "split"])


@register("m_gbt")
def q_gbt(spark, sf_dir):
    """Gradient boosting (100 rounds, rate 0.1, depth 5, seed 42): validation and test metrics."""
    return L.evaluate(_scored(spark, sf_dir, "GradientBoosting"), ["model", "split"])


@register("m_predict")
def q_predict(spark, sf_dir):
    s = _scored(spark, sf_dir, "RandomForest")
    return round_doubles(s.select("machine_id", "k1", "k2", "k3", "split", "pred", "score"))


@register("m_evaluate")
def q_evaluate(spark, sf_dir):
    data = split_frame(spark, sf_dir)
    both = _scored(spark, sf_dir, "RandomForest", data).unionByName(_scored(spark, sf_dir, "GradientBoosting", data))
    return L.evaluate(both, ["model", "split"])


def _importance(spark, sf_dir):
    model, _ = _model(spark, sf_dir, "RandomForest", train_frame(spark, sf_dir))
    return L.importances(spark, model, FEATURES)


@register("m_importance")
def q_importance(spark, sf_dir):
    return round_doubles(_importance(spark, sf_dir))


@register("j_feature_importance")
def q_j_importance(spark, sf_dir):
    """Feature names zipped with the importance vector by position."""
    model, _ = _model(spark, sf_dir, "RandomForest", train_frame(spark, sf_dir))
    imp = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame([(FEATURES, [float(x) for x in imp])], "names array<string>, imp array<double>")
    return round_doubles(df.select(F.inline(F.arrays_zip("names", "imp"))).toDF("feature", "importance"))


@register("t_importance_desc")
def q_imp_desc(spark, sf_dir):
    return round_doubles(_importance(spark, sf_dir).orderBy(F.col("importance").desc(), "feature"))


@register("t_importance_top8")
def q_imp_top8(spark, sf_dir):
    top = _importance(spark, sf_dir).orderBy(F.col("importance").desc(), "feature").limit(8)
    return round_doubles(top.orderBy("importance"))


@register("a_max_importance")
def q_max_importance(spark, sf_dir):
    return round_doubles(_importance(spark, sf_dir).agg(F.max("importance").alias("max_importance")))


@register("p_top_driver_flag")
def q_top_driver(spark, sf_dir):
    imp = _importance(spark, sf_dir)
    top = imp.orderBy(F.col("importance").desc(), "feature").limit(8)
    return round_doubles(top.withColumn("is_top_driver",
                                        F.col("importance") == F.max("importance").over(Window.partitionBy())))


_CORR = ", ".join(f"coalesce(abs(CASE WHEN isnan(corr({c}, is_failure)) THEN 0 ELSE corr({c}, is_failure) END), 0) AS {c}"
                  for c in FEATURES)


@register("m_importance_fallback", S.with_ctes(S.FEATURES, f"""row AS (SELECT {_CORR} FROM features),
t AS (SELECT *, {' + '.join(FEATURES)} AS total FROM row)
""") + " UNION ALL ".join(f"SELECT '{c}' AS feature, round({c} / total, 6) AS importance FROM t" for c in FEATURES))
def q_fallback(spark, sf_dir):
    """Importances without a fitted model: normalised absolute correlation with the failure label."""
    return round_doubles(L.fallback_importances(featured(spark, sf_dir), FEATURES, "is_failure"))


def _sequence_metrics(spark, sf_dir, data=None):
    data = split_frame(spark, sf_dir) if data is None else data
    seq = L.sequence_vectors(FE.sequences(data, ["ts", "k1", "k2", "k3"], FEATURES, "label", 12, keep=["split"]))
    train = seq.where(F.col("split") == "train")
    model = L.fit_cached("SequenceMLP", lambda: L.sequence_model(12 * len(FEATURES), step=len(FEATURES)),
                         train.select("machine_id", "ts", "k1", "k2", "k3", "raw", "label"), data.where(F.col("split") == "train"))
    pred = L.scored(model, seq.where(F.col("split") == "val"), "SequenceMLP")
    return L.evaluate(pred, ["model", "split"])


@register("m_sequence_model")
def q_sequence(spark, sf_dir):
    """Failure forecaster on the 12 preceding readings of each machine (MLP over the
    flattened, standardised window); F1 and ROC-AUC on the validation split."""
    return _sequence_metrics(spark, sf_dir)


@register("m_recurrent")
def q_recurrent(spark, sf_dir):
    """Failure forecaster with a recurrent cell over the 12 preceding readings; F1 and ROC-AUC on the validation split."""
    from shopfloor.operators import recurrent
    data = split_frame(spark, sf_dir)
    seq = materialize(FE.sequences(data, ["ts", "k1", "k2", "k3"], FEATURES, "label", 12, keep=["split"]), "sequence-rows")
    model = recurrent.fit_recurrent(seq.where(F.col("split") == "train"), epochs=30)
    if model is None:
        return L.evaluate(seq.select(F.lit("Recurrent").alias("model"), "split", "label", F.lit(0).alias("pred"), F.lit(0.0).alias("score"))
                          .where("false"), ["model", "split"])
    pred = model.score(seq.where(F.col("split") == "val")).withColumn("model", F.lit("Recurrent"))
    return L.evaluate(pred, ["model", "split"])


@register("m_compare")
def q_compare(spark, sf_dir):
    """Comparison table of measured test/val metrics of all models (no constants)."""
    data = split_frame(spark, sf_dir)
    rf = L.evaluate(_scored(spark, sf_dir, "RandomForest", data), ["model", "split"]).where(F.col("split") == "test")
    gb = L.evaluate(_scored(spark, sf_dir, "GradientBoosting", data), ["model", "split"]).where(F.col("split") == "test")
    sq = _sequence_metrics(spark, sf_dir, data)
    return rf.unionByName(gb).unionByName(sq)


register("u_stack_models")(q_compare)


@register("sink_model")
def q_sink_model(spark, sf_dir):
    """Save the fitted forest pipeline to the shared checkpoint folder, load it back and
    score with the loaded copy."""
    from pyspark.ml import PipelineModel

    model, data = _model(spark, sf_dir, "RandomForest")
    path = checkpoint_dir(spark, "model-rf")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    s = L.scored(loaded, data.where(F.col("split") == "test"), "RandomForest-loaded")
    return s.groupBy("model").agg(F.count(F.lit(1)).alias("n_scored"), F.sum("pred").alias("n_flagged"))


def _retrain(spark, sf_dir):
    """(params, metrics) of a forest refitted on the base readings plus the human-corrected events
    (REJECT flips the AI flag), measured on corrected events it has not seen."""
    feats = ["temperature", "vibration", "pressure"]
    corrected = q_decisions.q_feedback_events(spark, sf_dir).select(
        F.col("target_event_id").alias("event_id"), F.col("corrected_label").cast("double").alias("label"))
    events = materialize(B.readings(spark, sf_dir).join(corrected, "event_id").select("event_id", *feats, "label"), "corrected")
    unseen = F.floor(F.col("event_id") / 10) % 5 == 0
    base = cleaning.impute_and_cap(keyed_telemetry(spark, sf_dir)).select(*feats, F.col("is_failure").cast("double").alias("label"))
    n = events.count()
    train = materialize(base.unionByName(events.where(~unseen).select(*feats, "label")), "retrain-rows")
    model = L.fit_cached("Retrained", lambda: L.pipeline(feats, L.forest()), train)
    test = events.where(unseen).withColumn("split", F.lit("test"))
    ev = L.evaluate(L.scored(model, test, "Retrained"), ["model", "split"])
    return {"learning_rate": K.RETRAIN_LEARNING_RATE, "n_estimators": 100, "feedback_batch_size": n}, ev, n


@register("m_retrain")
def q_retrain(spark, sf_dir):
    """The refit, logged as a tracked run (params and measured metrics) and read back from its files."""
    params, ev, n = _retrain(spark, sf_dir)
    run, names = f"Retraining_Iter_{n + 1}", ["precision", "recall", "f1", "roc_auc"]
    metrics = ev.select(F.explode(F.array(*[F.struct(F.lit("metrics").alias("kind"), F.lit(m).alias("key"), F.col(m).cast("string")
                                                     .alias("value")) for m in names])).alias("x")).select("x.*")
    long = metrics.unionByName(spark.createDataFrame([("params", k, str(v)) for k, v in params.items()],
                                                     "kind string, key string, value string"))
    path = checkpoint_dir(spark, "retrain-run")
    FS.write_run_files(long.where("value is not null").withColumn("run_name", F.lit(run)), path, int(time.time() * 1000))
    return FS.read_run_files(spark, path).select("run_name", "kind", "key", "value")
