from pyspark.sql import functions as F

from shopfloor.functions import rules as R
from shopfloor.operators import evaluation as EV
from shopfloor.sources import bindings as B
from shopfloor.streaming import jobs as J

from conftest import SF_SMALL


def test_roc_auc_matches_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    t = B.telemetry(spark, SF_SMALL)
    df = t.select(F.col("is_failure").alias("y"),
                  R.machine_risk("temperature", "vibration", "pressure", "machine_id").alias("score"))
    ours = EV.roc_auc(df).first().roc_auc
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    ref = ev.evaluate(df.select(F.col("y").cast("double").alias("label"), "score"))
    assert abs(ours - ref) < 1e-9


def test_prf1_single_class_counts(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1)], "y int, pred int")
    c = EV.confusion(df).first()
    assert (c.tn, c.fp, c.fn, c.tp) == (2, 1, 0, 0)
    r = EV.prf1(EV.confusion(df)).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_stream_equals_batch(spark):
    s = J.run_to_parquet(J.risk_stream(spark, SF_SMALL), spark, "risk-test")
    r = B.readings(spark, SF_SMALL)
    b = r.select("event_id", "machine_id",
                 R.machine_risk("temperature", "vibration", "pressure", "machine_id").alias("failure_probability"))
    b = b.withColumn("health_status", R.machine_health("failure_probability"))
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def test_window_stream_emits_only_closed_windows(spark):
    w = J.run_to_parquet(J.window_stream(spark, SF_SMALL, 6), spark, "win-test")
    mx = B.readings(spark, SF_SMALL).agg(F.max("ts")).first()[0]
    import datetime
    wm = mx - datetime.timedelta(hours=24)
    assert w.count() > 0
    assert all(r.window_end <= wm for r in w.select("window_end").collect())
