"""Registered queries for the row rules: risk, health, alerts, defaults, labels,
production quality, incident text, explanation sentences, and the binary
classification metrics of the risk rule against the failure label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.functions import constants as K
from shopfloor.functions import rules as R
from shopfloor.operators import cleaning, evaluation
from shopfloor.plans import sqltext as S
from shopfloor.plans.registry import register, round_doubles
from shopfloor.sources import bindings as B

KEYS = ["ts", "machine_id", "k1", "k2", "k3"]


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.impute_and_cap(B.telemetry(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cleaned(spark, sf_dir)
    return c.withColumn("failure_probability",
                        R.machine_risk("temperature", "vibration", "pressure", "machine_id"))


_MR = S.machine_risk_sql()
_DR = S.dashboard_risk_sql()


@register("p_risk_machine", S.with_ctes(S.CLEANED, f"""x AS (SELECT 1)
SELECT {', '.join(KEYS)}, {_MR} AS failure_probability FROM capped"""))
def q_risk_machine(spark, sf_dir):
    return round_doubles(scored(spark, sf_dir).select(*KEYS, "failure_probability"))


@register("p_health_machine", S.with_ctes(S.CLEANED, f"""s AS (SELECT {_MR} AS p FROM capped)
SELECT {S.machine_health_sql('p')} AS health_status, count(*) AS n, round(avg(p), 6) AS mean_probability
FROM s GROUP BY 1"""))
def q_health_machine(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("health_status", R.machine_health("failure_probability"))
    return round_doubles(s.groupBy("health_status").agg(
        F.count(F.lit(1)).alias("n"), F.avg("failure_probability").alias("mean_probability")))


@register("p_risk_dashboard", S.with_ctes(S.CLEANED, f"""x AS (SELECT 1)
SELECT {', '.join(KEYS)}, {_DR} AS failure_probability,
  {S.dashboard_health_sql(_DR)} AS health_status FROM capped"""))
def q_risk_dashboard(spark, sf_dir):
    c = cleaned(spark, sf_dir).withColumn("failure_probability",
                                          R.dashboard_risk("temperature", "vibration", "pressure"))
    return round_doubles(c.select(*KEYS, "failure_probability",
                                  R.dashboard_health("failure_probability").alias("health_status")))


@register("p_health_dashboard", S.with_ctes(S.CLEANED, f"""s AS (SELECT {_DR} AS p FROM capped)
SELECT {S.dashboard_health_sql('p')} AS health_status, count(*) AS n FROM s GROUP BY 1"""))
def q_health_dashboard(spark, sf_dir):
    c = cleaned(spark, sf_dir).select(
        R.dashboard_health(R.dashboard_risk("temperature", "vibration", "pressure")).alias("health_status"))
    return c.groupBy("health_status").agg(F.count(F.lit(1)).alias("n"))


@register("p_sensor_alerts", S.with_ctes(S.CLEANED, f"""x AS (SELECT 1)
SELECT {', '.join(KEYS)}, coalesce(temperature > 75.0, false) AS temp_alert,
  coalesce(vibration > 3.5, false) AS vib_alert,
  coalesce(pressure < 85.0 OR pressure > 120.0, false) AS press_alert FROM capped"""))
def q_alerts(spark, sf_dir):
    return cleaned(spark, sf_dir).select(*KEYS, *R.sensor_alerts("temperature", "vibration", "pressure"))


@register("p_live_failure_flag", S.with_ctes(S.CLEANED, f"""x AS (SELECT 1)
SELECT {', '.join(KEYS)}, CAST({_DR} > 0.6 AS INTEGER) AS is_failure_live FROM capped"""))
def q_live_flag(spark, sf_dir):
    p = R.dashboard_risk("temperature", "vibration", "pressure")
    return cleaned(spark, sf_dir).select(*KEYS, R.threshold_class(p, 0.6).alias("is_failure_live"))


@register("p_threshold_predict", S.with_ctes(S.CLEANED, f"""x AS (SELECT 1)
SELECT {', '.join(KEYS)}, CAST({_MR} > 0.5 AS INTEGER) AS prediction FROM capped"""))
def q_threshold(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEYS, R.threshold_class("failure_probability").alias("prediction"))


_PD = ("coalesce(temperature, 60.0) AS temperature, coalesce(vibration, 1.8) AS vibration, "
       "coalesce(pressure, 30.0) AS pressure, coalesce(machine_id, 'MCH-01 CNC Mill') AS machine_id")


@register("p_payload_defaults", S.with_ctes(S.TELEMETRY, f"""d AS (SELECT ts, k1, k2, k3, {_PD} FROM telemetry)
SELECT ts, machine_id, k1, k2, k3, round(temperature, 6) AS temperature, round(vibration, 6) AS vibration,
  round(pressure, 6) AS pressure, {_MR} AS failure_probability FROM d"""))
def q_defaults(spark, sf_dir):
    t = B.telemetry(spark, sf_dir)
    d = t.select("ts", "k1", "k2", "k3", *R.payload_defaults("temperature", "vibration", "pressure", "machine_id"))
    d = d.withColumn("failure_probability", R.machine_risk("temperature", "vibration", "pressure", "machine_id"))
    return round_doubles(d.select(*KEYS, "temperature", "vibration", "pressure", "failure_probability"))


def _baseline_sql(table, other, col="machine_id"):
    whens = " ".join(f"WHEN contains({col}, '{n}') THEN CAST({v} AS DOUBLE)" for n, v in table)
    return f"CASE {whens} ELSE CAST({other} AS DOUBLE) END"


_BT = _baseline_sql(K.BASELINE_TEMPERATURE, K.BASELINE_TEMPERATURE_OTHER)
_BV = _baseline_sql(K.BASELINE_VIBRATION, K.BASELINE_VIBRATION_OTHER)
_BP = _baseline_sql(K.BASELINE_PRESSURE, K.BASELINE_PRESSURE_OTHER)
_BR = _baseline_sql(K.BASELINE_RPM, K.BASELINE_RPM_OTHER)


@register("p_baseline_by_kind", S.with_ctes(S.CLEANED, f"""x AS (SELECT 1)
SELECT machine_id, {_BT} AS base_temperature, {_BV} AS base_vibration, {_BP} AS base_pressure,
  {_BR} AS base_rpm, round(avg(temperature - {_BT}), 6) AS temp_excess,
  round(avg(vibration - {_BV}), 6) AS vib_excess FROM capped GROUP BY machine_id"""))
def q_baseline(spark, sf_dir):
    m = F.col("machine_id")
    bt = R.baseline_level(m, K.BASELINE_TEMPERATURE, K.BASELINE_TEMPERATURE_OTHER)
    bv = R.baseline_level(m, K.BASELINE_VIBRATION, K.BASELINE_VIBRATION_OTHER)
    out = cleaned(spark, sf_dir).groupBy("machine_id").agg(
        F.avg(F.col("temperature") - bt).alias("temp_excess"),
        F.avg(F.col("vibration") - bv).alias("vib_excess"))
    out = out.select("machine_id", bt.alias("base_temperature"), bv.alias("base_vibration"),
                     R.baseline_level(m, K.BASELINE_PRESSURE, K.BASELINE_PRESSURE_OTHER).alias("base_pressure"),
                     R.baseline_level(m, K.BASELINE_RPM, K.BASELINE_RPM_OTHER).alias("base_rpm"),
                     "temp_excess", "vib_excess")
    return round_doubles(out)


_WIN = "(k1 % 180) BETWEEN 165 AND 179"


@register("p_anomaly_window", S.with_ctes(S.TELEMETRY, f"""x AS (SELECT 1)
SELECT {_WIN} AS in_anomaly_window, count(*) AS n, CAST(sum(is_failure) AS BIGINT) AS n_threshold_failures
FROM telemetry GROUP BY 1"""))
def q_anomaly_window(spark, sf_dir):
    t = B.telemetry(spark, sf_dir).withColumn("in_anomaly_window", R.in_anomaly_window("k1"))
    return t.groupBy("in_anomaly_window").agg(F.count(F.lit(1)).alias("n"),
                                              F.sum("is_failure").cast("long").alias("n_threshold_failures"))


@register("p_failure_label", S.with_ctes(S.TELEMETRY, f"""x AS (SELECT 1)
SELECT {', '.join(KEYS)},
  CASE WHEN {_WIN} AND (temperature > 88.0 OR vibration > 5.0) THEN 1 ELSE 0 END AS window_label,
  CASE WHEN {_WIN} AND (temperature > 88.0 OR vibration > 5.0) THEN '{K.FAILURE_TYPE}' END AS window_failure_type
FROM telemetry"""))
def q_failure_label(spark, sf_dir):
    t = B.telemetry(spark, sf_dir)
    lab = R.failure_label("k1", "temperature", "vibration")
    return t.select(*KEYS, lab.alias("window_label"), R.failure_type(lab).alias("window_failure_type"))


@register("p_quality_score", S.with_ctes(S.PRODUCTION, """x AS (SELECT 1)
SELECT batch_id, line_id, machine_id, units_produced, defect_count,
  round(greatest(0.0, 100.0 - CAST(defect_count AS DOUBLE) / CAST(units_produced AS DOUBLE) * 100), 1)
    AS quality_score
FROM production"""))
def q_quality(spark, sf_dir):
    return B.production(spark, sf_dir).select("batch_id", "line_id", "machine_id", "units_produced",
                                              "defect_count", "quality_score")


@register("p_has_defect", S.with_ctes(S.PRODUCTION, """x AS (SELECT 1)
SELECT coalesce(CASE WHEN defect_count = 0 THEN NULL WHEN kind < 4 THEN 'Crack' WHEN kind < 7 THEN 'Scratch'
                     WHEN kind < 9 THEN 'Overheat' ELSE 'Misalignment' END, 'None') AS defect_type,
       count(*) AS n_batches, CAST(sum(defect_count) AS BIGINT) AS n_defects
FROM production GROUP BY 1"""))
def q_has_defect(spark, sf_dir):
    p = B.production(spark, sf_dir)
    return p.groupBy(F.coalesce("defect_type", F.lit("None")).alias("defect_type")).agg(
        F.count(F.lit(1)).alias("n_batches"), F.sum("defect_count").cast("long").alias("n_defects"))


def incident_sql(text: str) -> tuple[str, str]:
    low = f"lower({text})"
    urg, mode = [], []
    for u, m, words in K.INCIDENT_RULES:
        cond = " OR ".join(f"contains({low}, '{w}')" for w in words)
        urg.append(f"WHEN {cond} THEN '{u}'")
        mode.append(f"WHEN {cond} THEN '{m}'")
    return (f"CASE {' '.join(urg)} ELSE '{K.INCIDENT_DEFAULT[0]}' END",
            f"CASE {' '.join(mode)} ELSE '{K.INCIDENT_DEFAULT[1]}' END")


def action_sql(urg: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.INCIDENT_ACTIONS.items())
    return f"CASE {urg} {whens} END"


_IU, _IM = incident_sql("incident_text")


@register("p_incident_class", S.with_ctes(S.INCIDENTS, f"""x AS (SELECT 1)
SELECT event_id, log_id, machine_id, labelled_urgency, {_IU} AS urgency_level,
  {_IM} AS detected_failure_mode FROM incidents"""))
def q_incident_class(spark, sf_dir):
    i = B.incidents(spark, sf_dir)
    return i.select("event_id", "log_id", "machine_id", "labelled_urgency", *R.incident_class("incident_text"))


@register("p_incident_action", S.with_ctes(S.INCIDENTS, f"""c AS (SELECT {_IU} AS urgency_level FROM incidents)
SELECT urgency_level, {action_sql('urgency_level')} AS recommended_nlp_action, count(*) AS n
FROM c GROUP BY 1"""))
def q_incident_action(spark, sf_dir):
    i = B.incidents(spark, sf_dir).select(R.incident_class("incident_text")[0])
    return i.groupBy("urgency_level").agg(F.count(F.lit(1)).alias("n")).select(
        "urgency_level", R.incident_action("urgency_level").alias("recommended_nlp_action"), "n")


_DU, _DM = incident_sql("text")


@register("p_incident_class_docs", f"""SELECT doc_id, {_DU} AS urgency_level, {_DM} AS detected_failure_mode,
  {action_sql(_DU)} AS recommended_nlp_action FROM documents""")
def q_incident_docs(spark, sf_dir):
    """The incident classifier over whole document texts (every word of every document)."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", *R.incident_class("text"))
    return d.withColumn("recommended_nlp_action", R.incident_action("urgency_level"))


def explain_sql(p: str, t: str, v: str, pr: str) -> str:
    t, v, pr = f"coalesce({t}, 70.0)", f"coalesce({v}, 2.0)", f"coalesce({pr}, 100.0)"
    vib = (f"CASE WHEN {v} > 3.5 THEN 'Vibration (' || CAST({v} AS VARCHAR) || ' mm/s) is +' || "
           f"printf('%.0f', ({v} - 2.5) / 2.5 * 100) || '% above normal baseline' END")
    tmp = (f"CASE WHEN {t} > 80.0 THEN 'Operating temperature (' || CAST({t} AS VARCHAR) || "
           f"'°C) exceeds warning threshold of 80°C' END")
    prs = (f"CASE WHEN {pr} > 120.0 OR {pr} < 85.0 THEN 'Hydraulic pressure (' || CAST({pr} AS VARCHAR) || "
           f"' bar) is outside optimal 90-110 bar window' END")
    reasons = f"concat_ws('; ', {vib}, {tmp}, {prs})"
    return (f"CASE WHEN {reasons} = '' THEN 'Model Confidence: ' || printf('%.1f', 100.0 - {p} * 100) || "
            f"'% Normal. All sensor telemetry signals remain within healthy operational limits.' "
            f"ELSE 'Failure Risk Confidence: ' || printf('%.1f', {p} * 100) || '%. Primary Drivers: ' || "
            f"{reasons} || '.' END")


@register("p_explain_sentence", S.with_ctes(S.READINGS, f"""s AS (SELECT *, {_DR} AS p FROM readings)
SELECT event_id, p AS failure_probability, {explain_sql('p', 'temperature', 'vibration', 'pressure')}
  AS explanation FROM s"""))
def q_explain(spark, sf_dir):
    r = B.readings(spark, sf_dir).withColumn("p", R.dashboard_risk("temperature", "vibration", "pressure"))
    return r.select("event_id", F.col("p").alias("failure_probability"),
                    R.explanation_sentence("p", "temperature", "vibration", "pressure").alias("explanation"))


# --- classification metrics of the machine risk rule (threshold 0.5) -----------------

_SCORED = S.with_ctes(S.CLEANED, f"""sc AS (SELECT is_failure AS y, {_MR} AS score,
  CAST({_MR} > 0.5 AS INTEGER) AS pred FROM capped)""")


@register("a_confusion", _SCORED + """
SELECT count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
       count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp
FROM sc""")
def q_confusion(spark, sf_dir):
    return evaluation.confusion(_scored_labels(spark, sf_dir))


def _scored_labels(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select(F.col("is_failure").alias("y"), F.col("failure_probability").alias("score"),
                    R.threshold_class("failure_probability").alias("pred"))


@register("a_prf1", _SCORED + """,
c AS (SELECT count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn,
             count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp FROM sc)
SELECT round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 4) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 4) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1
FROM c""")
def q_prf1(spark, sf_dir):
    return evaluation.prf1(evaluation.confusion(_scored_labels(spark, sf_dir)))


@register("a_error_text", _SCORED + """,
c AS (SELECT count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn
      FROM sc)
SELECT 'Error Analysis: ' || CAST(fn AS VARCHAR) || ' missed failures (False Negatives - critical risk) and '
       || CAST(fp AS VARCHAR) || ' false alarms (False Positives).' AS explanation FROM c""")
def q_error_text(spark, sf_dir):
    return evaluation.error_text(evaluation.confusion(_scored_labels(spark, sf_dir)))


@register("a_roc_auc", _SCORED + """,
g AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY score),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             AS neg_below FROM g)
SELECT round(sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM c""")
def q_auc(spark, sf_dir):
    return round_doubles(evaluation.roc_auc(_scored_labels(spark, sf_dir)))
