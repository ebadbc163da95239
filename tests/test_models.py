"""Fitted models on the small tables: quality thresholds, caching by the data, the tracked refit."""

from pyspark.sql import functions as F

from shopfloor.operators import features as FE
from shopfloor.operators import learning as L
from shopfloor.plans import q_learning as Q
from shopfloor.sources import bindings as B

from conftest import SF_SMALL


def test_forest_quality_and_refit(spark):
    got = {r.split: r for r in Q.q_rf(spark, SF_SMALL).collect()}
    assert got["val"].roc_auc >= 0.9 and got["test"].roc_auc >= 0.9 and got["test"].f1 >= 0.8
    run = {(r.kind, r.key): r.value for r in Q.q_retrain(spark, SF_SMALL).collect()}
    assert run[("params", "feedback_batch_size")] > 0 and 0 <= run[("metrics", "precision")] <= 1


def test_model_cache_follows_the_data(spark):
    feats = ["temperature", "vibration"]
    t = L.with_label(B.telemetry(spark, SF_SMALL).na.fill(0.0).limit(400)).select("k1", "k2", "k3", *feats, "label").checkpoint()

    def fit(df):
        return L.fit_cached("cache-test", lambda: L.pipeline(feats, L.forest().setNumTrees(3)), df)
    assert fit(t) is fit(t)
    assert fit(t) is not fit(t.where(F.col("k2") > 1))


def test_split_by_borders_equals_positions(spark):
    t = B.telemetry(spark, SF_SMALL)
    order = ["ts", "machine_id", "k1", "k2", "k3"]
    pos, ends = FE.split_positions(t, order)
    want = pos.select("k1", "k2", "k3", "machine_id", FE.split_name("row_index", ends).alias("split"))
    got = FE.with_split(t, order).select(*want.columns)
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect()))
    tiny = t.limit(1)
    assert [r.split for r in FE.with_split(tiny, order).collect()] == ["test"]


def test_split_rows_are_stored(spark):
    """Fits and scorings read the split rows many times: no reading may clean, shuffle and sort the telemetry again."""
    rows = Q.split_frame(spark, SF_SMALL)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    assert rows.count() == B.telemetry(spark, SF_SMALL).where(F.col("machine_id").isNotNull()).count()


def test_comparison_builds_its_rows_once(spark, monkeypatch):
    calls, build = [], Q.split_frame
    monkeypatch.setattr(Q, "split_frame", lambda *a: calls.append(a) or build(*a))
    monkeypatch.setattr(L, "_MODELS", {})
    monkeypatch.setattr(Q.L, "boosting", lambda: Q.L.GBTClassifier(featuresCol="features", labelCol="label", maxIter=2))
    assert {r.model for r in Q.q_compare(spark, SF_SMALL).collect()} == {"RandomForest", "GradientBoosting", "SequenceMLP"}
    assert len(calls) == 1


def test_rows_are_scored_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def score(x):
        seen.add(1)
        return x
    rows = spark.createDataFrame([(f"{k % 2}", float(k % 5 > 2), k % 3 % 2, k / 40) for k in range(40)], "split string, label double, pred int, s double")
    got = L.evaluate(rows.coalesce(1).withColumn("score", F.udf(score, "double")("s")), ["split"]).collect()
    assert len(got) == 2 and seen.value == 40


def test_importances_store_training_rows_only(spark, monkeypatch):
    """No key columns, no rows that a fit does not read; the fitted model is the one that scoring queries use."""
    stored, write = [], Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df, purpose: stored.append(write(df, purpose)) or stored[-1])
    monkeypatch.setattr(L, "_MODELS", {})
    monkeypatch.setattr(Q.L, "forest", lambda: L.RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=2, maxDepth=2, seed=1))
    assert Q.q_importance(spark, SF_SMALL).count() == Q.q_j_importance(spark, SF_SMALL).count() == len(Q.FEATURES)
    assert all(set(t.columns) == {*Q.FEATURES, "label", "split"} and t.where("split <> 'train'").isEmpty() for t in stored)
    rows = Q.split_frame(spark, SF_SMALL)
    assert rows.where("split = 'train'").count() == stored[0].count() and len(stored) == 3
    Q._model(spark, SF_SMALL, "RandomForest", rows)
    assert len(L._MODELS) == 1
