"""The fitted cleaning stage: trained on the train split, saved, loaded, applied to tables and streams."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from shopfloor.functions.constants import CleaningParams
from shopfloor.operators import cleaning
from shopfloor.operators.cleaner import SensorCleaner, SensorCleanerModel
from shopfloor.sources import bindings as B
from shopfloor.streaming import jobs as J

from conftest import SF_SMALL

SENSORS = ["temperature", "vibration", "pressure"]
KEYS = ["machine_id", "k1", "k2", "k3"]


def rows(df, cols):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


def test_equals_cleaning_by_hand(spark):
    t = B.telemetry(spark, SF_SMALL)
    model = SensorCleaner().fit(t)
    assert model.fitted == {k: v for k, v in cleaning.fit_stats(t).items()}
    cols = [*KEYS, "temperature", "vibration", "pressure", "rpm"]
    assert rows(model.transform(t), cols) == rows(cleaning.impute_and_cap(t), cols)


def test_fitted_on_train_rows_only(spark):
    t = B.telemetry(spark, SF_SMALL)
    train = t.where("k1 % 10 < 7")
    shifted = t.withColumn("temperature", F.when(F.col("k1") % 10 >= 7, 1e6).otherwise(F.col("temperature")))
    a, b = SensorCleaner().fit(train), SensorCleaner().fit(shifted.where("k1 % 10 < 7"))
    assert a.fitted == b.fitted
    assert a.transform(shifted).agg(F.max("temperature")).first()[0] <= a.fitted["hi_temperature"]


def test_saved_pipeline_scores_a_stream_without_fitting(spark, tmp_path, monkeypatch):
    readings = B.readings(spark, SF_SMALL).withColumn("vibration", F.when(F.col("event_id") % 5 > 0, F.col("vibration")))
    cleaner = SensorCleaner(sensors=SENSORS, capped=["temperature"], flags=True)
    model = Pipeline(stages=[cleaner]).fit(readings.where("event_id % 2 = 0"))
    model.write().overwrite().save(str(tmp_path / "model"))
    monkeypatch.setattr(cleaning, "fit_stats", None)  # nothing may fit again
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert isinstance(loaded.stages[0], SensorCleanerModel) and loaded.stages[0].fitted == model.stages[0].fitted
    stream = B.readings(spark, SF_SMALL, events=J.event_stream(spark, SF_SMALL)) \
        .withColumn("vibration", F.when(F.col("event_id") % 5 > 0, F.col("vibration")))
    cols = ["event_id", *SENSORS, "temperature_outlier"]
    got = J.run_to_parquet(loaded.transform(stream).select(*cols), spark, "cleaned")
    assert rows(got, cols) == rows(model.transform(readings), cols)
    assert got.where("vibration IS NULL").count() == 0


def test_gaps_that_come_after_training_are_filled(spark):
    p = {"sensors": ["v", "w"], "capped": ["v"]}
    model = SensorCleaner(**p).fit(spark.createDataFrame([(float(k), None) for k in range(9)], "v double, w double"))
    got = model.transform(spark.createDataFrame([(None, None), (100.0, 3.0)], "v double, w double")).collect()
    assert (got[0].v, got[0].w) == (4.0, None) and got[1].v == model.fitted["hi_v"] and got[1].w == 3.0
    assert CleaningParams(sensors=("v",)).iqr_factor == model.getOrDefault("iqrFactor")
