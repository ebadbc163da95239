"""Event fan-in, decision matrix, human decision log and retraining bookkeeping.

The per-event "agents" become tables keyed by event: maintenance facts come from
the reading itself, vision facts from the per-image verdict table (equi-join on
the image key), knowledge facts from retrieval over the *distinct* incident texts
(a handful of queries, joined back by text slot; that table is bounded by the
number of templates, so it is broadcast).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.functions import constants as K
from shopfloor.functions import rules as R
from shopfloor.operators.positions import row_positions, running_totals


def maintenance_facts(readings: DataFrame) -> DataFrame:
    p = R.machine_risk("temperature", "vibration", "pressure", "machine_id")
    return readings.withColumn("failure_probability", p) \
        .withColumn("health_status", R.machine_health("failure_probability"))


def event_fan_in(maint: DataFrame, vision: DataFrame, knowledge: DataFrame) -> DataFrame:
    """maint(event_id, image_id, slot, ...) + vision(image_id, defect_type, severity,
    confidence) + knowledge(slot, top_source, top_content, evidence) -> one row per event."""
    v = vision.select("image_id", "defect_type", "severity", "confidence")
    k = knowledge.select("slot", "top_source", "top_content", "evidence")
    j = maint.join(v, "image_id", "left").join(k, "slot", "left")
    return j.withColumn("top_source", F.coalesce("top_source", F.lit(K.DEFAULT_TOP_SOURCE)))


def with_decision(df: DataFrame) -> DataFrame:
    return df.select("*", *R.decision_matrix("failure_probability", "severity", "machine_id", "top_source"),
                     R.contributing_agents().alias("contributing_agents"))


def decision_records(decisions: DataFrame, recommendation: DataFrame) -> DataFrame:
    """The logged decision row: text timestamp, recommendation of the reviewed event,
    notes with the default when empty, constant queue status."""
    rec = recommendation.select(F.col("event_id").alias("target_event_id"), "final_recommendation")
    d = decisions.join(rec, "target_event_id", "left")
    return d.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "event_id", "target_event_id",
        F.col("final_recommendation").alias("ai_recommendation"), "decision_type", "supervisor_id",
        F.coalesce(F.nullif(F.col("notes_in"), F.lit("")), F.lit(K.DEFAULT_DECISION_NOTES)).alias("notes"),
        F.lit(K.DECISION_STATUS).alias("status"), "ts")


def is_valid_decision(col: str = "decision_type") -> Column:
    return F.col(col).isin(*K.DECISION_TYPES)


def latest_per(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last row per key; Spark limits each map task to one row per key before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def retrain_params(n: Column) -> list[Column]:
    return [F.lit(K.RETRAIN_LEARNING_RATE).alias("learning_rate"),
            (F.lit(K.RETRAIN_BASE_ESTIMATORS) + n * K.RETRAIN_ESTIMATORS_STEP).cast("long").alias("n_estimators"),
            n.cast("long").alias("feedback_batch_size"),
            F.concat(F.lit("Retraining_Iter_"), (n + 1).cast("string")).alias("run_name")]


RUN_METRICS = ("approve_rate", "reject_rate", "modify_rate", "feedback_rows")


def run_metrics(n: Column, approved: Column, rejected: Column, modified: Column) -> list[Column]:
    """Measured values of a learning cycle over the first ``n`` decisions of the log."""
    return [F.round(F.coalesce(x / F.nullif(n, F.lit(0)), F.lit(0.0)), 4).alias(name)
            for name, x in zip(RUN_METRICS, (approved, rejected, modified))] + [n.cast("long").alias(RUN_METRICS[3])]


def learning_runs(log: DataFrame) -> DataFrame:
    """One run per decision of ``log`` (ts, event_id, decision_type): name, params and what the log up
    to and including it measures; running totals over ranges, no single-partition window."""
    kinds = {"_a": "APPROVE", "_r": "REJECT", "_m": "MODIFY"}
    rows = log.select("ts", "event_id", F.lit(1).alias("_n"), *[(F.col("decision_type") == v).cast("int").alias(k)
                                                             for k, v in kinds.items()])
    t = running_totals(rows, ["ts", "event_id"], ["_n", *kinds])
    upto = {c: F.col(f"{c}_before") + F.col(c) for c in ("_n", *kinds)}
    return t.select(*run_metrics(upto["_n"], upto["_a"], upto["_r"], upto["_m"]), *retrain_params(upto["_n"]))


def iterations(log: DataFrame) -> DataFrame:
    """Iteration number of every decision in log order (ts, event_id), without a
    single-partition window."""
    return row_positions(log, ["ts", "event_id"], (), "_pos").withColumn("iteration", F.col("_pos") + 1) \
        .drop("_pos")


def run_log_long(runs: DataFrame, metrics: list[str], params: Sequence[str] = ()) -> DataFrame:
    """Wide run rows -> (run_name, kind, key, value) like one tracked metric or param per file."""
    return runs.select("run_name", F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(m).alias("key"), F.col(m).cast("double").alias("value"))
        for kind, names in (("metrics", metrics), ("params", params)) for m in names])))


def run_log_wide(long: DataFrame, metrics: list[str]) -> DataFrame:
    return long.groupBy("run_name").pivot("key", metrics).agg(F.first("value"))
