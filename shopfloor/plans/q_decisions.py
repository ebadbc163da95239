"""Registered queries: event fan-in and decision matrix, incident report rows, the
supervisor decision log (validation, audit counts, latest per event, review queue,
corrected labels) and the retraining bookkeeping (iterations, params, formula
metrics, run-log pivot)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopfloor.functions import constants as K
from shopfloor.functions import rules as R
from shopfloor.operators import decisions as D
from shopfloor.operators import imaging as I
from shopfloor.operators import scenarios as SC
from shopfloor.plans import q_imaging, q_retrieval, q_scenarios
from shopfloor.plans import sqltext as S
from shopfloor.plans.registry import register, round_doubles
from shopfloor.sources import bindings as B

# --- Spark side ----------------------------------------------------------------------


def vision_table(spark, sf_dir):
    return I.surface_verdicts(I.image_stats(I.with_gradients(B.pixels(spark, sf_dir))))


def knowledge_table(spark, sf_dir):
    """Evidence for every distinct incident text (slot = event_id % 6): the best section's source
    and content, and the evidence block of the best two."""
    inc = B.incidents(spark, sf_dir)
    queries = inc.select((F.col("event_id") % 6).alias("query_id"), F.col("incident_text").alias("query")) \
        .distinct()
    ev = q_retrieval.evidence_of(q_retrieval.index(spark, sf_dir), queries)
    block = F.concat(F.lit("Source: "), "source", F.lit("\n"), "content")
    lst = ev.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "source", "content", block.alias("block"))))
                                     .alias("ev"))
    return lst.select(F.col("query_id").alias("slot"), F.col("ev")[0]["source"].alias("top_source"),
                      F.col("ev")[0]["content"].alias("top_content"),
                      F.array_join(F.transform("ev", lambda e: e["block"]), "\n\n").alias("evidence"))


def fill_text(template: str, values: dict) -> Column:
    """The template as a Column, every {name} replaced by its value's text."""
    parts = re.split(r"\{(" + "|".join(values) + r")\}", template)
    return F.concat(*[values[x].cast("string") if n % 2 else F.lit(x) for n, x in enumerate(parts)])


def fill_text_sql(template: str, values: dict) -> str:
    parts = re.split(r"\{(" + "|".join(values) + r")\}", template)
    return " || ".join(f"CAST({values[x]} AS VARCHAR)" if n % 2 else "'" + x.replace("'", "''") + "'"
                       for n, x in enumerate(parts))


def fan_in(spark, sf_dir):
    r = B.readings(spark, sf_dir).withColumn("slot", F.col("event_id") % 6)
    m = D.maintenance_facts(r)
    return D.with_decision(D.event_fan_in(m, vision_table(spark, sf_dir), knowledge_table(spark, sf_dir)))


# --- SQL side --------------------------------------------------------------------------

_INC_QUERIES = (f"queries AS (SELECT DISTINCT CAST(event_id % 6 AS BIGINT) AS query_id, "
                f"{S._tmpl_case(0)} AS query FROM events)")
_SEV = "coalesce(severity, 'None')"
_P = "failure_probability"
_URG = f"({_P} > 0.6 OR {_SEV} = 'Critical')"
_HIGH = f"({_P} > 0.3 OR {_SEV} = 'Moderate')"


def _tmpl_sql(tpl: str) -> str:
    out = "'" + tpl.replace("'", "''") + "'"
    return out.replace("{m}", "' || machine_id || '").replace("{s}", "' || top_source || '")


FANIN = S.with_ctes(S.READINGS, q_retrieval.tfidf_sql(_INC_QUERIES), q_imaging.BASE, f"""
maint AS (SELECT event_id, machine_id, temperature, vibration, pressure, image_id, event_id % 6 AS slot,
                 {S.machine_risk_sql()} AS failure_probability FROM readings),
evd AS (SELECT t.query_id, t.rank, c.source, c.content FROM topk t JOIN chunks c USING (doc_id, section_no)),
know AS (SELECT query_id AS slot, max(CASE WHEN rank = 1 THEN source END) AS top_source,
                max(CASE WHEN rank = 1 THEN content END) AS top_content,
                string_agg('Source: ' || source || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS evidence
         FROM evd GROUP BY query_id),
fan AS (SELECT m.*, k.top_content, k.evidence, {S.machine_health_sql('m.failure_probability')} AS health_status,
               v.defect_type, v.severity, v.confidence,
               coalesce(k.top_source, '{K.DEFAULT_TOP_SOURCE}') AS top_source
        FROM maint m LEFT JOIN vd v USING (image_id) LEFT JOIN know k USING (slot)),
dec AS (SELECT *,
  CASE WHEN {_URG} THEN '{K.DECISION_URGENT[0]}' WHEN {_HIGH} THEN '{K.DECISION_HIGH[0]}'
       ELSE '{K.DECISION_LOW[0]}' END AS final_recommendation,
  CASE WHEN {_URG} THEN '{K.DECISION_URGENT[1]}' WHEN {_HIGH} THEN '{K.DECISION_HIGH[1]}'
       ELSE '{K.DECISION_LOW[1]}' END AS priority,
  CASE WHEN {_URG} THEN {_tmpl_sql(K.DECISION_URGENT[2])} WHEN {_HIGH} THEN {_tmpl_sql(K.DECISION_HIGH[2])}
       ELSE {_tmpl_sql(K.DECISION_LOW[2])} END AS action_summary
  FROM fan)""")


@register("j_event_fanin", FANIN + """
SELECT event_id, machine_id, failure_probability, health_status, defect_type, severity, top_source FROM dec""")
def q_fanin(spark, sf_dir):
    return round_doubles(fan_in(spark, sf_dir).select("event_id", "machine_id", "failure_probability",
                                                      "health_status", "defect_type", "severity", "top_source"))


@register("p_decision_matrix", FANIN + " SELECT event_id, final_recommendation, priority FROM dec")
def q_matrix(spark, sf_dir):
    return fan_in(spark, sf_dir).select("event_id", "final_recommendation", "priority")


@register("p_action_summary", FANIN + " SELECT event_id, action_summary FROM dec")
def q_action(spark, sf_dir):
    return fan_in(spark, sf_dir).select("event_id", "action_summary")


@register("p_contributors", FANIN + f"""
SELECT event_id, '{', '.join(K.AGENT_NAMES)}' AS contributing_agents, final_recommendation FROM dec""")
def q_contributors(spark, sf_dir):
    return fan_in(spark, sf_dir).select("event_id", F.array_join("contributing_agents", ", ")
                                        .alias("contributing_agents"), "final_recommendation")


@register("t_top_source_events", FANIN + " SELECT slot, top_source, count(*) AS n_events FROM dec GROUP BY ALL")
def q_top_source_events(spark, sf_dir):
    """Knowledge agent per event: top section for the event's incident text or the default."""
    return fan_in(spark, sf_dir).groupBy("slot", "top_source").agg(F.count(F.lit(1)).alias("n_events"))


def _shown_sql(value: str, digits: int) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(18, 6)), {digits}) AS DOUBLE)"


def _shown(value: Column, digits: int) -> Column:
    """A measured value rounded half up from its six-decimal form, so that a value on a rounding tie
    (59.505) reads the same whichever binary neighbour it is stored as."""
    return F.round(value.cast("decimal(18,6)"), digits).cast("double")


_TEXT_SQL = {"machine": "machine_id", "probability": _shown_sql("failure_probability", 4),
             "vibration": _shown_sql("vibration", 2), "temperature": _shown_sql("temperature", 2),
             "percent": f"printf('%.1f', {_shown_sql('failure_probability * 100', 1)})",
             "source": "top_source", "content": f"coalesce(top_content, '{K.DEFAULT_EVIDENCE_CONTENT}')", "action": "action_summary"}


def _text_values() -> dict:
    return {"machine": F.col("machine_id"), "probability": _shown(F.col("failure_probability"), 4),
            "vibration": _shown(F.col("vibration"), 2), "temperature": _shown(F.col("temperature"), 2),
            "percent": F.format_string("%.1f", _shown(F.col("failure_probability") * 100, 1)), "source": F.col("top_source"),
            "content": F.coalesce("top_content", F.lit(K.DEFAULT_EVIDENCE_CONTENT)), "action": F.col("action_summary")}


@register("p_explain_grounded", FANIN + f" SELECT event_id, {fill_text_sql(K.GROUNDED_EXPLANATION, _TEXT_SQL)} AS explanation FROM dec")
def q_grounded(spark, sf_dir):
    """The grounded explanation used when no language model is called: the event's own readings,
    the evidence found for it and the decided action."""
    return fan_in(spark, sf_dir).select("event_id", fill_text(K.GROUNDED_EXPLANATION, _text_values()).alias("explanation"))


_SUMMARY_SQL = fill_text_sql(K.PROMPT_SUMMARY, _TEXT_SQL)


@register("p_prompt", FANIN + f"""
SELECT event_id, {fill_text_sql(K.PROMPT, {"summary": "summary", "evidence": "evidence"})} AS prompt
FROM (SELECT *, {_SUMMARY_SQL} AS summary FROM dec)""")
def q_prompt(spark, sf_dir):
    """The whole prompt per event: model output as JSON, evidence block, instructions."""
    summary = fill_text(K.PROMPT_SUMMARY, _text_values())
    return fan_in(spark, sf_dir).select(
        "event_id", fill_text(K.PROMPT, {"summary": summary, "evidence": F.col("evidence")}).alias("prompt"))


# --- incident report rows ------------------------------------------------------------------

_REPORT_SQL = S.with_ctes(FANIN, f"""
s AS (SELECT event_id, machine_id, {S.dashboard_risk_sql()} AS p FROM readings),
sc AS ({q_scenarios._scenario_sql()}),
sct AS (SELECT event_id, string_agg(name || ' | ' || CAST(units_lost AS VARCHAR) || ' | '
          || printf('%.1f', failure_risk_pct) || '% | $' || format('{{:,.2f}}', estimated_financial_loss),
          chr(10) ORDER BY scenario_id) AS scenario_table FROM sc GROUP BY event_id)
SELECT d.event_id, d.machine_id, printf('%.1f', s.p * 100) || '%' AS failure_risk,
  coalesce(d.severity, 'Critical') AS vision_severity, d.final_recommendation AS recommendation,
  coalesce(d.defect_type, 'Crack') AS defect_type,
  printf('%.1f', coalesce(d.confidence, 0.94) * 100) || '%' AS vision_confidence,
  d.top_source AS sop_source, d.action_summary, t.scenario_table
FROM dec d JOIN s USING (event_id) JOIN sct t USING (event_id)""")


@register("p_report_row", _REPORT_SQL)
def q_report(spark, sf_dir):
    """One incident report record per event: formatted percentages, money and the
    scenario table (built in-row from the scenario array, no join)."""
    f = fan_in(spark, sf_dir)
    p = R.dashboard_risk("temperature", "vibration", "pressure")
    lines = F.transform(SC.scenario_array(p), lambda s: F.concat(
        s["name"], F.lit(" | "), s["units_lost"].cast("string"), F.lit(" | "),
        F.format_string("%.1f", s["failure_risk_pct"]), F.lit("% | $"),
        F.format_string("%,.2f", s["estimated_financial_loss"])))
    return f.select(
        "event_id", "machine_id", F.concat(F.format_string("%.1f", p * 100), F.lit("%")).alias("failure_risk"),
        F.coalesce("severity", F.lit("Critical")).alias("vision_severity"),
        F.col("final_recommendation").alias("recommendation"),
        F.coalesce("defect_type", F.lit("Crack")).alias("defect_type"),
        F.concat(F.format_string("%.1f", F.coalesce("confidence", F.lit(0.94)) * 100), F.lit("%"))
        .alias("vision_confidence"),
        F.col("top_source").alias("sop_source"), "action_summary",
        F.array_join(lines, "\n").alias("scenario_table"))


# --- decision log ---------------------------------------------------------------------------

_MR_REC = (f"CASE WHEN {S.machine_risk_sql()} > 0.6 THEN '{K.DECISION_URGENT[0]}' "
           f"WHEN {S.machine_risk_sql()} > 0.3 THEN '{K.DECISION_HIGH[0]}' ELSE '{K.DECISION_LOW[0]}' END")
LOG = S.with_ctes(S.READINGS, S.DECISIONS, f"""
rec AS (SELECT event_id AS target_event_id, {_MR_REC} AS ai_recommendation,
               CAST({S.machine_risk_sql()} > 0.5 AS INTEGER) AS ai_flag FROM readings),
log AS (SELECT strftime(d.ts, '%Y-%m-%d %H:%M:%S') AS timestamp, d.ts, d.event_id, d.target_event_id,
               r.ai_recommendation, d.decision_type, d.supervisor_id,
               coalesce(nullif(d.notes_in, ''), '{K.DEFAULT_DECISION_NOTES}') AS notes,
               '{K.DECISION_STATUS}' AS status
        FROM decisions d LEFT JOIN rec r USING (target_event_id)),
valid AS (SELECT * FROM log WHERE decision_type IN ('APPROVE', 'REJECT', 'MODIFY'))""")


def _recommendations(spark, sf_dir):
    m = D.maintenance_facts(B.readings(spark, sf_dir))
    return m.select("event_id", *R.decision_matrix("failure_probability", F.lit(None), "machine_id",
                                                   F.lit(None))[:1],
                    R.threshold_class("failure_probability").alias("ai_flag"))


def decision_log(spark, sf_dir):
    d = B.decisions(spark, sf_dir)
    return D.decision_records(d, _recommendations(spark, sf_dir))


def valid_log(spark, sf_dir):
    return decision_log(spark, sf_dir).where(D.is_valid_decision())


_LOG_COLS = ["timestamp", "event_id", "target_event_id", "ai_recommendation", "decision_type",
             "supervisor_id", "notes", "status"]


@register("p_decision_record", LOG + f" SELECT {', '.join(_LOG_COLS)} FROM log")
def q_record(spark, sf_dir):
    return decision_log(spark, sf_dir).select(*_LOG_COLS)


@register("s_nvl_notes", LOG + " SELECT notes, count(*) AS n FROM log GROUP BY notes")
def q_notes(spark, sf_dir):
    return decision_log(spark, sf_dir).groupBy("notes").agg(F.count(F.lit(1)).alias("n"))


@register("p_decision_valid", LOG + """
SELECT decision_type IN ('APPROVE', 'REJECT', 'MODIFY') AS is_valid, count(*) AS n FROM log GROUP BY 1""")
def q_valid(spark, sf_dir):
    """Valid decisions go to the log; the rest form a rejects table (counted here)."""
    return decision_log(spark, sf_dir).groupBy(D.is_valid_decision().alias("is_valid")) \
        .agg(F.count(F.lit(1)).alias("n"))


@register("a_feedback_count", LOG + " SELECT count(*) AS n_feedback FROM valid")
def q_count(spark, sf_dir):
    return valid_log(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_feedback"))


@register("a_feedback_by_type", LOG + """
SELECT decision_type, count(*) AS n, count(DISTINCT supervisor_id) AS n_supervisors FROM valid GROUP BY 1""")
def q_by_type(spark, sf_dir):
    return valid_log(spark, sf_dir).groupBy("decision_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("supervisor_id").alias("n_supervisors"))


_LATEST = LOG + """,
latest AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY target_event_id
                                                         ORDER BY ts DESC, event_id DESC) = 1)"""


@register("w_latest_decision", _LATEST + " SELECT target_event_id, event_id, decision_type FROM latest")
def q_latest(spark, sf_dir):
    return D.latest_per(valid_log(spark, sf_dir), "target_event_id", ["ts", "event_id"]) \
        .select("target_event_id", "event_id", "decision_type")


@register("j_feedback_events", _LATEST + """
SELECT l.target_event_id, l.decision_type, r.ai_flag,
  CASE WHEN l.decision_type = 'REJECT' THEN 1 - r.ai_flag ELSE r.ai_flag END AS corrected_label
FROM latest l JOIN rec r USING (target_event_id)""")
def q_feedback_events(spark, sf_dir):
    """Latest decision per reviewed event joined to the scored event: corrected labels."""
    latest = D.latest_per(valid_log(spark, sf_dir), "target_event_id", ["ts", "event_id"])
    rec = _recommendations(spark, sf_dir).select(F.col("event_id").alias("target_event_id"), "ai_flag")
    j = latest.join(rec, "target_event_id")
    return j.select("target_event_id", "decision_type", "ai_flag",
                    F.when(F.col("decision_type") == "REJECT", 1 - F.col("ai_flag"))
                    .otherwise(F.col("ai_flag")).alias("corrected_label"))


@register("j_unreviewed", LOG + """
SELECT r.event_id, r.machine_id FROM readings r
WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.target_event_id = r.event_id)""")
def q_unreviewed(spark, sf_dir):
    """Review queue: scored events without any valid decision (anti join)."""
    r = B.readings(spark, sf_dir).select("event_id", "machine_id")
    v = valid_log(spark, sf_dir).select(F.col("target_event_id").alias("event_id"))
    return r.join(v, "event_id", "left_anti")


@register("u_feedback_union", LOG + """
SELECT decision_type, count(*) AS n FROM (
  SELECT decision_type FROM valid WHERE decision_type = 'APPROVE'
  UNION ALL SELECT decision_type FROM valid WHERE decision_type <> 'APPROVE') GROUP BY 1""")
def q_union(spark, sf_dir):
    """History + new decisions as one log (unionByName of two appended parts)."""
    v = valid_log(spark, sf_dir)
    hist = v.where(F.col("decision_type") == "APPROVE")
    new = v.where(F.col("decision_type") != "APPROVE")
    return hist.unionByName(new).groupBy("decision_type").agg(F.count(F.lit(1)).alias("n"))


# --- retraining bookkeeping --------------------------------------------------------------------

_RATES = {"approve_rate": "APPROVE", "reject_rate": "REJECT", "modify_rate": "MODIFY"}


def _rates_sql(over: str) -> str:
    """Measured run values: shares of the decision kinds, over a window or as an aggregate."""
    return ", ".join(f"round(coalesce(CAST(sum(CASE WHEN decision_type = '{v}' THEN 1 ELSE 0 END) {over} AS DOUBLE) / "
                     f"nullif(count(*) {over}, 0), 0), 4) AS {k}" for k, v in _RATES.items()) + f", count(*) {over} AS feedback_rows"


def _params_sql(n: str) -> str:
    return (f"CAST({K.RETRAIN_LEARNING_RATE} AS DOUBLE) AS learning_rate, "
            f"CAST({K.RETRAIN_BASE_ESTIMATORS} + {n} * {K.RETRAIN_ESTIMATORS_STEP} AS BIGINT) AS n_estimators, "
            f"CAST({n} AS BIGINT) AS feedback_batch_size, 'Retraining_Iter_' || CAST({n} + 1 AS VARCHAR) AS run_name")


@register("p_retrain_params", LOG + f" SELECT {_params_sql('n')} FROM (SELECT count(*) AS n FROM valid)")
def q_params(spark, sf_dir):
    c = valid_log(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    return c.select(*D.retrain_params(F.col("n")))


@register("p_retrain_metrics", LOG + f" SELECT {_rates_sql('')} FROM valid")
def q_metrics(spark, sf_dir):
    """What the decision log measures for the next learning cycle."""
    kind = {k: F.sum((F.col("decision_type") == v).cast("long")).alias(k) for k, v in _RATES.items()}
    c = valid_log(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), *kind.values())
    return c.select(*D.run_metrics(F.col("n"), *[F.col(k) for k in kind]))


_ITER = LOG + """,
it AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS iteration FROM valid)"""


@register("w_retrain_iteration", _ITER + """
SELECT event_id, iteration, 'Retraining_Iter_' || CAST(iteration + 1 AS VARCHAR) AS run_name FROM it""")
def q_iteration(spark, sf_dir):
    it = D.iterations(valid_log(spark, sf_dir))
    return it.select("event_id", "iteration",
                     F.concat(F.lit("Retraining_Iter_"), (F.col("iteration") + 1).cast("string")).alias("run_name"))


_METRIC_KEYS, _PARAM_KEYS = list(D.RUN_METRICS), ["learning_rate", "n_estimators", "feedback_batch_size"]


def _runs(spark, sf_dir):
    return D.learning_runs(valid_log(spark, sf_dir))


RUNS = _ITER + f""",
runs AS (SELECT {_rates_sql('OVER w')}, {_params_sql('count(*) OVER w')}
         FROM valid WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


@register("a_run_pivot", RUNS + f"""
SELECT run_name, {', '.join(f'CAST({k} AS DOUBLE) AS {k}' for k in _METRIC_KEYS)} FROM runs""")
def q_pivot(spark, sf_dir):
    """Tracked runs: metrics long (one value per run and key) pivoted back to wide."""
    long = D.run_log_long(_runs(spark, sf_dir), _METRIC_KEYS).drop("kind")
    return round_doubles(D.run_log_wide(long, _METRIC_KEYS))
