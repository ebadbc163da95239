"""Registered source/sink queries. Each writes data derived from the driver tables
into the shared checkpoint folder with the sink under test, reads it back with the
matching source and returns what was read, so the round trip is oracle-checked."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from shopfloor.operators import decisions as D
from shopfloor.operators import imaging as I
from shopfloor.plans import q_decisions
from shopfloor.plans import sqltext as S
from shopfloor.plans.q_imaging import BASE as IMAGING
from shopfloor.plans.q_telemetry import featured
from shopfloor.plans.registry import register, round_doubles, rsel
from shopfloor.session import checkpoint_dir
from shopfloor.sources import bindings as B
from shopfloor.sources import files as FS

KEYS = ["ts", "machine_id", "k1", "k2", "k3"]
_TEL = KEYS + ["temperature", "vibration", "pressure", "rpm", "voltage", "is_failure", "failure_type"]
_DBL = ["temperature", "vibration", "pressure", "rpm", "voltage"]


@register("src_telemetry_csv", S.with_ctes(S.TELEMETRY, f"x AS (SELECT 1) SELECT {rsel(_TEL, _DBL)} FROM telemetry"))
def q_telemetry_csv(spark, sf_dir):
    """Raw telemetry -> CSV (header, text timestamps, 'None' for missing) -> typed read."""
    path = checkpoint_dir(spark, "telemetry-csv")
    FS.write_csv(FS.with_text_ts(B.telemetry(spark, sf_dir)).select("timestamp", *_TEL[1:]), path)
    back = FS.read_csv(spark, path, FS.TELEMETRY_CSV_SCHEMA)
    return round_doubles(back.select(F.col("timestamp").cast("timestamp_ntz").alias("ts"), *_TEL[1:]))


register("sink_raw_csv", S.with_ctes(S.TELEMETRY, f"x AS (SELECT 1) SELECT {rsel(_TEL, _DBL)} FROM telemetry"))(
    q_telemetry_csv)
register("p_parse_ts", S.with_ctes(S.TELEMETRY, f"x AS (SELECT 1) SELECT {rsel(_TEL, _DBL)} FROM telemetry"))(
    q_telemetry_csv)

_PROD = ["batch_id", "line_id", "machine_id", "ts", "units_produced", "defect_count", "quality_score", "defect_type"]


@register("src_production_csv", S.with_ctes(S.PRODUCTION, """x AS (SELECT 1)
SELECT batch_id, line_id, machine_id, ts, units_produced, defect_count,
  round(greatest(0.0, 100.0 - CAST(defect_count AS DOUBLE) / CAST(units_produced AS DOUBLE) * 100), 1)
    AS quality_score,
  CASE WHEN defect_count = 0 THEN NULL WHEN kind < 4 THEN 'Crack' WHEN kind < 7 THEN 'Scratch'
       WHEN kind < 9 THEN 'Overheat' ELSE 'Misalignment' END AS defect_type FROM production"""))
def q_production_csv(spark, sf_dir):
    path = checkpoint_dir(spark, "production-csv")
    p = FS.with_text_ts(B.production(spark, sf_dir))
    FS.write_csv(p.select(*[c if c != "ts" else "timestamp" for c in _PROD]), path)
    back = FS.read_csv(spark, path, FS.PRODUCTION_CSV_SCHEMA)
    return back.withColumnRenamed("timestamp", "ts").withColumn("ts", F.col("ts").cast("timestamp_ntz")) \
        .select(*_PROD)


@register("src_maintenance_csv", S.with_ctes(S.INCIDENTS, """x AS (SELECT 1)
SELECT log_id, ts, machine_id, incident_text, labelled_urgency AS urgency_level, action_taken, downtime_hours
FROM incidents"""))
def q_maintenance_csv(spark, sf_dir):
    """Maintenance log text with commas and quotes survives the CSV round trip."""
    path = checkpoint_dir(spark, "maintenance-csv")
    i = FS.with_text_ts(B.incidents(spark, sf_dir)).select(
        "log_id", "timestamp", "machine_id", "incident_text", F.col("labelled_urgency").alias("urgency_level"),
        "action_taken", "downtime_hours")
    FS.write_csv(i, path)
    back = FS.read_csv(spark, path, FS.MAINTENANCE_CSV_SCHEMA)
    return back.select("log_id", F.col("timestamp").cast("timestamp_ntz").alias("ts"), "machine_id",
                       "incident_text", "urgency_level", "action_taken", "downtime_hours")


_FEAT = KEYS + ["is_failure"] + S.FEATURE_COLUMNS


@register("sink_clean", S.with_ctes(S.FEATURES, f"x AS (SELECT 1) SELECT {rsel(_FEAT, S.FEATURE_COLUMNS)} FROM features"))
def q_sink_clean(spark, sf_dir):
    """Cleaned telemetry written as parquet range-clustered by machine and time, so a
    machine filter skips files by min/max statistics (no directory per machine)."""
    path = checkpoint_dir(spark, "clean")
    f = featured(spark, sf_dir)
    f.repartitionByRange("machine_id", "ts").sortWithinPartitions("machine_id", "ts", "k1", "k2", "k3") \
        .write.mode("overwrite").parquet(path)
    return round_doubles(spark.read.parquet(path).select(*_FEAT))


@register("cache_loaded", S.with_ctes(S.CLEANED, """x AS (SELECT 1)
SELECT count(*) AS n, round(avg(temperature), 6) AS mean_temperature FROM capped"""))
def q_cache(spark, sf_dir):
    """Loaded telemetry persisted once because two jobs (statistics, then the capped
    projection) read it."""
    from shopfloor.operators import cleaning
    t = B.telemetry(spark, sf_dir).persist()
    try:
        out = cleaning.impute_and_cap(t).agg(F.count(F.lit(1)).alias("n"),
                                             F.avg("temperature").alias("mean_temperature"))
        rows = out.collect()
    finally:
        t.unpersist()
    return round_doubles(spark.createDataFrame(rows, out.schema))


_LOG_CNT = q_decisions.LOG + """
SELECT decision_type, supervisor_id, count(*) AS n FROM valid GROUP BY decision_type, supervisor_id"""


@register("sink_feedback_append", _LOG_CNT)
def q_feedback_append(spark, sf_dir):
    """Valid decisions appended to the JSON log in two writes (history, then new ones)."""
    path = checkpoint_dir(spark, "feedback-json")
    v = q_decisions.valid_log(spark, sf_dir)
    FS.append_decisions(v.where(F.col("decision_type") == "APPROVE"), path)
    FS.append_decisions(v.where(F.col("decision_type") != "APPROVE"), path)
    back = FS.read_decision_log(spark, path)
    return back.groupBy("decision_type", "supervisor_id").agg(F.count(F.lit(1)).alias("n"))


@register("src_feedback_json", _LOG_CNT)
def q_feedback_json(spark, sf_dir):
    """Reading the log: explicit schema, permissive; a missing log reads as empty."""
    path = checkpoint_dir(spark, "feedback-json")
    missing = FS.read_decision_log(spark, path + "-missing")
    FS.append_decisions(q_decisions.valid_log(spark, sf_dir), path)
    back = FS.read_decision_log(spark, path).unionByName(missing)
    return back.groupBy("decision_type", "supervisor_id").agg(F.count(F.lit(1)).alias("n"))


@register("src_manuals_text", S.with_ctes(S.CHUNKS, """x AS (SELECT 1)
SELECT CAST(doc_id AS VARCHAR) AS source, count(*) AS n_sections, CAST(sum(length(content)) AS BIGINT) AS n_chars
FROM chunks GROUP BY doc_id"""))
def q_manuals(spark, sf_dir):
    """Documents written as a bundle of manuals, read back whole, then sectioned."""
    path = checkpoint_dir(spark, "manuals")
    FS.write_manuals(B.table(spark, sf_dir, "documents"), path)
    m = FS.read_manual_bundle(spark, path).withColumn("doc_id", F.col("source"))
    sec = B.section_rows(m.select("doc_id", "source", "text"), "\n", 20)
    return sec.groupBy(F.col("doc_id").alias("source")).agg(
        F.count(F.lit(1)).alias("n_sections"), F.sum(F.length("content")).cast("long").alias("n_chars"))


def _image_files(spark, sf_dir):
    path = checkpoint_dir(spark, "images")
    px = B.pixels(spark, sf_dir).withColumn(
        "label_dir", F.when(F.col("label") < 5, F.lit("normal")).otherwise(F.lit("defect")))
    FS.write_tiles_as_png(px, path)
    return FS.read_images(spark, path)


@register("src_images", IMAGING + """
SELECT image_id, n_pixels, round(heat_ratio, 6) AS heat_ratio, round(grey_range, 6) AS grey_range,
       defect_type, severity FROM vd""")
def q_images(spark, sf_dir):
    """Tiles written as PNG files, read with the image source (BGR bytes), exploded to
    pixels per Arrow batch and analysed like the table pixels."""
    im = _image_files(spark, sf_dir)
    px = I.image_pixels(im).withColumn(
        "image_id", F.regexp_extract("image_id", r"/(\d+)\.png$", 1).cast("long"))
    v = I.surface_verdicts(I.image_stats(I.with_gradients(px)))
    return round_doubles(v.select("image_id", "n_pixels", "heat_ratio", "grey_range", "defect_type", "severity"))


@register("src_image_label", """SELECT CASE WHEN label < 5 THEN 'normal' ELSE 'defect' END AS label_dir,
  count(*) AS n_images FROM embeddings GROUP BY 1""")
def q_image_label(spark, sf_dir):
    """Class of every image file from its parent folder."""
    return _image_files(spark, sf_dir).groupBy("label_dir").agg(F.count(F.lit(1)).alias("n_images"))


_RUNS_SQL = q_decisions.RUNS + " " + " UNION ALL ".join(
    f"SELECT run_name, '{kind}' AS kind, '{k}' AS key, CAST({k} AS DOUBLE) AS value FROM runs"
    for kind, names in (("metrics", q_decisions._METRIC_KEYS), ("params", q_decisions._PARAM_KEYS)) for k in names)


def _run_log(spark, sf_dir):
    path = checkpoint_dir(spark, "runs")
    long = D.run_log_long(q_decisions._runs(spark, sf_dir), q_decisions._METRIC_KEYS, q_decisions._PARAM_KEYS)
    FS.write_run_files(long, path, int(time.time() * 1000))
    return path


@register("sink_run_log", _RUNS_SQL)
def q_run_log(spark, sf_dir):
    """Params and measured metrics of every learning run written as run files, read back as a long table."""
    return FS.read_run_files(spark, _run_log(spark, sf_dir)).select("run_name", "kind", "key", "value")


@register("src_run_files", q_decisions.RUNS + f"""
SELECT run_name, CAST(0 AS BIGINT) AS step, {', '.join(f'CAST({k} AS DOUBLE) AS {k}' for k in q_decisions._METRIC_KEYS)} FROM runs""")
def q_run_files(spark, sf_dir):
    """The metric files of all runs, one row per run."""
    m = FS.read_run_files(spark, _run_log(spark, sf_dir)).where("kind = 'metrics'")
    return m.groupBy("run_name", "step").pivot("key", q_decisions._METRIC_KEYS).agg(F.first("value"))
