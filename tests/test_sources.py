from pyspark.sql import functions as F

from shopfloor.session import checkpoint_dir
from shopfloor.sources import bindings as B
from shopfloor.sources import files as FS

from conftest import SF_SMALL


def test_missing_decision_log_reads_empty(spark):
    path = checkpoint_dir(spark, "no-log") + "-never-written"
    df = FS.read_decision_log(spark, path)
    assert df.count() == 0
    assert [f.name for f in df.schema.fields] == [f.name for f in FS.DECISION_SCHEMA.fields]


def test_csv_none_text_reads_as_null(spark):
    path = checkpoint_dir(spark, "csv-none")
    t = B.telemetry(spark, SF_SMALL)
    FS.write_csv(FS.with_text_ts(t).select("timestamp", *[c for c in t.columns if c != "ts"]), path)
    raw_text = spark.read.text(path).where(F.col("value").contains(",None")).count()
    back = FS.read_csv(spark, path, FS.TELEMETRY_CSV_SCHEMA)
    assert raw_text > 0
    assert back.where(F.col("vibration").isNull()).count() == t.where(F.col("vibration").isNull()).count()
    assert back.where(F.col("timestamp").isNull()).count() == 0


def test_run_files_round_trip(spark):
    path = checkpoint_dir(spark, "runs-test")
    long = spark.createDataFrame([("Retraining_Iter_2", "precision", 0.93), ("Retraining_Iter_2", "recall", 0.905)],
                                 "run_name string, key string, value double")
    FS.write_run_files(long, path, 1700000000000)
    back = {(r.run_name, r.key): (r.value, r.epoch_ms, r.step) for r in FS.read_run_files(spark, path).collect()}
    assert back == {("Retraining_Iter_2", "precision"): (0.93, 1700000000000, 0),
                    ("Retraining_Iter_2", "recall"): (0.905, 1700000000000, 0)}


def test_decision_log_as_json_array(spark, tmp_path):
    """One indented array, as a human-in-the-loop tool writes it, and the same as JSON lines."""
    import json
    rows = [{"timestamp": "2026-01-01 08:00:00", "event_id": f"EVT-{i}", "ai_recommendation": "REDUCE_LOAD", "decision_type": "APPROVE",
             "supervisor_id": "S-1", "notes": "line one\nline two", "status": "LOGGED"} for i in range(11)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(r) for r in rows))
    for name in ("a.json", "b.json"):
        got = FS.read_decision_log(spark, str(tmp_path / name))
        assert sorted(r.event_id for r in got.collect()) == sorted(r["event_id"] for r in rows)
        assert got.where("notes is null or decision_type is null").count() == 0
    (tmp_path / "c.json").write_text("{not json")
    import pytest
    with pytest.raises(Exception):
        FS.read_decision_log(spark, str(tmp_path / "c.json")).collect()


def test_nine_column_sensor_csv(spark, tmp_path):
    """Columns are found by the header, not by position."""
    (tmp_path / "s.csv").write_text(
        "timestamp,machine_id,temperature,vibration,pressure,rpm,voltage,is_failure,failure_type\n"
        "2026-01-01 08:00:00,MCH-01,70.5,,101.0,2990.1,221.0,0,None\n2026-01-01 09:00:00,MCH-02,999.0,4.2,100.0,3000.0,220.0,1,Overheating/Vibration\n"
        "2026-01-01 10:00:00,MCH-03,1.0\n")
    got = FS.read_csv(spark, str(tmp_path / "s.csv"), FS.TELEMETRY_CSV_SCHEMA, corrupt_col="raw").orderBy("timestamp").collect()
    assert [(r.temperature, r.rpm, r.vibration, r.is_failure, r.k1) for r in got[:2]] == [(70.5, 2990.1, None, 0, None), (999.0, 3000.0, 4.2, 1, None)]
    assert got[0].failure_type is None and got[2].raw == "2026-01-01 10:00:00,MCH-03,1.0" and got[0].raw is None


def test_plain_folder_of_manuals(spark, tmp_path):
    (tmp_path / "pump.txt").write_text("first\n\nsecond")
    (tmp_path / "press.txt").write_bytes(b"ok \xff end")
    got = {r.source: r.text for r in FS.read_manuals(spark, str(tmp_path)).collect()}
    assert got == {"pump.txt": "first\n\nsecond", "press.txt": "ok  end"}


def test_run_folders_with_params(spark, tmp_path):
    run = tmp_path / "337" / "a1318b"
    for kind, files in (("metrics", {"f1_score": "1784000000000 0.917 0\n", "recall": "1784000000000 0.905 0\n"}),
                        ("params", {"n_estimators": "125", "note": "plain words"}), ("tags", {"mlflow.user": "x"})):
        (run / kind).mkdir(parents=True)
        for k, v in files.items():
            (run / kind / k).write_text(v)
    (run / "meta.yaml").write_text("status: 3\n")
    got = {(r.run_name, r.kind, r.key): (r.value, r.epoch_ms, r.step, r.text) for r in FS.read_run_files(spark, str(tmp_path)).collect()}
    assert got == {("a1318b", "metrics", "f1_score"): (0.917, 1784000000000, 0, None),
                   ("a1318b", "metrics", "recall"): (0.905, 1784000000000, 0, None),
                   ("a1318b", "params", "n_estimators"): (125.0, None, None, "125"),
                   ("a1318b", "params", "note"): (None, None, None, "plain words")}


def test_invalid_images_are_kept(spark, tmp_path):
    (tmp_path / "normal").mkdir()
    (tmp_path / "normal" / "1.png").write_bytes(FS.png_bytes(2, 2, bytes(12)))
    (tmp_path / "normal" / "2.png").write_bytes(b"not an image")
    got = sorted(r.status for r in FS.read_images(spark, str(tmp_path)).collect())
    assert got == ["invalid", "ok"]


def test_stream_over_part_files_equals_batch(spark, tmp_path):
    from shopfloor.streaming import jobs as J
    import os
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for t in ("customer", "supplier"):
        os.symlink(f"{SF_SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    want = J.run_to_parquet(J.risk_stream(spark, SF_SMALL), spark, "one-file")
    got = J.run_to_parquet(J.risk_stream(spark, str(tmp_path)), spark, "part-files")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0
    log = J.run_to_parquet(J.feedback_stream(spark, str(tmp_path)), spark, "part-files-log")
    assert log.count() == J.run_to_parquet(J.feedback_stream(spark, SF_SMALL), spark, "one-file-log").count()


def test_late_and_replayed_decisions_over_micro_batches(spark, tmp_path):
    """One file per micro-batch: a replay within the watermark is dropped, so is a row older than it."""
    import datetime
    import os
    import time

    from shopfloor.streaming import jobs as J
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    base = ev.where("event_type = 'purchase'").limit(1).drop("ts", "event_id")
    t0 = datetime.datetime(2026, 1, 1, 12)
    out = tmp_path / "events.parquet"
    files = [[(1, t0), (2, t0 + datetime.timedelta(minutes=5))],
             [(1, t0 + datetime.timedelta(minutes=1)), (3, t0 + datetime.timedelta(hours=5))],
             [(5, t0 + datetime.timedelta(hours=6))], [(4, t0), (6, t0 + datetime.timedelta(hours=6))]]
    out.mkdir()
    for n, rows in enumerate(files):
        part = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").crossJoin(base).select(*ev.columns)
        part.coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        name = next(p for p in (tmp_path / f"w{n}").iterdir() if p.name.endswith(".parquet"))
        os.rename(name, out / f"{n}.parquet")
        os.utime(out / f"{n}.parquet", (time.time() - 100 + n, time.time() - 100 + n))
    got = J.run_to_parquet(J.feedback_stream(spark, str(tmp_path), max_files=1), spark, "late")
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 3, 5, 6]
    whole = J.run_to_parquet(J.feedback_stream(spark, str(tmp_path)), spark, "whole")
    assert sorted(r.event_id for r in whole.collect()) == [1, 2, 3, 4, 5, 6]


def test_csv_keeps_fractions_of_a_second(spark):
    import datetime as dt
    stamps = [dt.datetime(2024, 1, 1, 0, 0, 7, 179575), dt.datetime(2024, 1, 1, 0, 0, 7), dt.datetime(1999, 12, 31, 23, 59, 59, 1), None]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(stamps)], "log_id string, ts timestamp_ntz")
    path = checkpoint_dir(spark, "csv-fractions")
    FS.write_csv(FS.with_text_ts(df), path)
    texts = {r.log_id: r.timestamp for r in spark.read.option("header", True).csv(path).collect()}
    assert (texts["0"], texts["1"]) == ("2024-01-01 00:00:07.179575", "2024-01-01 00:00:07")
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("log_id", T.StringType()), T.StructField("timestamp", T.StringType())])
    back = FS.read_csv(spark, path, schema).select("log_id", F.col("timestamp").cast("timestamp_ntz").alias("ts"))
    assert [r.ts for r in back.orderBy("log_id").collect()] == stamps
