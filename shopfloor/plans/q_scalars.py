"""Small oracle-checked queries for the scalar functions, lookups and unions, each
run over a whole driver table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shopfloor.functions import constants as K
from shopfloor.functions import rules as R
from shopfloor.operators import cleaning
from shopfloor.operators import scenarios as SC
from shopfloor.plans import q_retrieval, q_scenarios
from shopfloor.plans import sqltext as S
from shopfloor.plans.q_telemetry import featured
from shopfloor.plans.registry import register, round_doubles
from shopfloor.sources import bindings as B

KEYS = ["ts", "machine_id", "k1", "k2", "k3"]


@register("j_stats", S.with_ctes(S.CLEANED, f"""x AS (SELECT 1)
SELECT {', '.join(KEYS)}, round(i.temperature, 6) AS temperature, round(lo_temperature, 6) AS lo_temperature,
  round(hi_temperature, 6) AS hi_temperature, round(st.med_vibration, 6) AS med_vibration
FROM imputed i, bnd, st"""))
def q_stats(spark, sf_dir):
    """Every row with the one-row global statistics attached (fitted once, applied as literals)."""
    t = B.telemetry(spark, sf_dir)
    st = cleaning.fit_stats(t)
    i = cleaning.impute_median(t, st, K.SENSOR_COLUMNS)
    return round_doubles(i.select(*KEYS, "temperature", F.lit(st["lo_temperature"]).alias("lo_temperature"),
                                  F.lit(st["hi_temperature"]).alias("hi_temperature"),
                                  F.lit(st["med_vibration"]).alias("med_vibration")))


@register("j_template_lookup", S.with_ctes(S.INCIDENTS, """x AS (SELECT 1)
SELECT incident_text, labelled_urgency, action_taken, count(*) AS n FROM incidents GROUP BY ALL"""))
def q_template(spark, sf_dir):
    """Row i takes template i % 6: an in-row array lookup instead of a join."""
    return B.incidents(spark, sf_dir).groupBy("incident_text", "labelled_urgency", "action_taken") \
        .agg(F.count(F.lit(1)).alias("n"))


@register("s_lower", """SELECT doc_id, CAST(length(lower(text)) AS INTEGER) AS n_chars,
  CAST(length(text) - length(replace(lower(text), 'e', '')) AS INTEGER) AS n_e FROM documents""")
def q_lower(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    low = F.lower("text")
    return d.select("doc_id", F.length(low).alias("n_chars"),
                    (F.length("text") - F.length(F.replace(low, F.lit("e"), F.lit("")))).alias("n_e"))


@register("s_contains", S.with_ctes(S.TELEMETRY, """x AS (SELECT 1)
SELECT contains(machine_id, 'Hydraulic') AS is_hydraulic, contains(machine_id, 'CNC') AS is_cnc, count(*) AS n
FROM telemetry GROUP BY ALL"""))
def q_contains(spark, sf_dir):
    t = B.telemetry(spark, sf_dir)
    return t.groupBy(F.col("machine_id").contains("Hydraulic").alias("is_hydraulic"),
                     F.col("machine_id").contains("CNC").alias("is_cnc")).agg(F.count(F.lit(1)).alias("n"))


_KW = [w for _, _, ws in K.INCIDENT_RULES for w in ws]


@register("s_contains_any", "SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{w}')" for w in _KW)
          + " AS has_incident_keyword FROM documents")
def q_contains_any(spark, sf_dir):
    low = F.lower("text")
    cond = None
    for w in _KW:
        cond = low.contains(w) if cond is None else cond | low.contains(w)
    return B.table(spark, sf_dir, "documents").select("doc_id", cond.alias("has_incident_keyword"))


@register("s_fmt_ids", """SELECT vec_id, CASE WHEN label < 5 THEN 'normal_' ELSE 'defect_' END
  || lpad(CAST(vec_id AS VARCHAR), 3, '0') || '.png' AS file_name, 'LINE-0' || CAST(vec_id % 3 + 1 AS VARCHAR) AS line_id
FROM embeddings""")
def q_fmt_ids(spark, sf_dir):
    e = B.table(spark, sf_dir, "embeddings")
    name = F.concat(F.when(F.col("label") < 5, F.lit("normal_")).otherwise(F.lit("defect_")),
                    F.lpad(F.col("vec_id").cast("string"), 3, "0"), F.lit(".png"))
    return e.select("vec_id", name.alias("file_name"),
                    F.concat(F.lit("LINE-0"), (F.col("vec_id") % 3 + 1).cast("string")).alias("line_id"))


_SC = S.with_ctes(S.READINGS, f"""s AS (SELECT event_id, machine_id, {S.dashboard_risk_sql()} AS p FROM readings),
sc AS ({q_scenarios._scenario_sql()})""")


def _sc(spark, sf_dir):
    r = B.readings(spark, sf_dir).select("event_id", R.dashboard_risk("temperature", "vibration", "pressure")
                                         .alias("p"))
    return SC.scenarios(r, "p", ["event_id"])


@register("s_fmt_money", _SC + """
SELECT event_id, scenario_id, '$' || format('{:,.2f}', estimated_financial_loss) AS loss_text FROM sc""")
def q_money(spark, sf_dir):
    return _sc(spark, sf_dir).select("event_id", "scenario_id", F.concat(
        F.lit("$"), F.format_string("%,.2f", "estimated_financial_loss")).alias("loss_text"))


@register("s_fmt_pct", _SC + """
SELECT event_id, scenario_id, printf('%.1f', failure_risk_pct) || '%' AS risk_text,
  printf('%.2f', downtime_hours) AS downtime_text FROM sc""")
def q_pct(spark, sf_dir):
    return _sc(spark, sf_dir).select(
        "event_id", "scenario_id", F.concat(F.format_string("%.1f", "failure_risk_pct"), F.lit("%")).alias("risk_text"),
        F.format_string("%.2f", "downtime_hours").alias("downtime_text"))


@register("s_trunc", _SC + " SELECT event_id, scenario_id, units_lost FROM sc")
def q_trunc(spark, sf_dir):
    """int(x) toward zero for units lost."""
    return _sc(spark, sf_dir).select("event_id", "scenario_id", "units_lost")


@register("s_join", """SELECT doc_id, concat_ws('; ', lang, source, CAST(n_chars AS VARCHAR)) AS joined FROM documents""")
def q_join(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("; ", "lang", "source", F.col("n_chars").cast("string")).alias("joined"))


@register("s_map_get", S.with_ctes(S.INCIDENTS, f"""x AS (SELECT 1)
SELECT event_id, coalesce(CASE labelled_urgency {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in K.INCIDENT_ACTIONS.items())}
  END, 'No action') AS action FROM incidents"""))
def q_map_get(spark, sf_dir):
    i = B.incidents(spark, sf_dir)
    return i.select("event_id", F.coalesce(R.incident_action("labelled_urgency"), F.lit("No action")).alias("action"))


@register("s_modulo", """SELECT CAST(l_suppkey % 4 AS INTEGER) AS kind, CAST(l_orderkey % 180 >= 165 AS BOOLEAN) AS in_window,
  count(*) AS n FROM lineitem GROUP BY ALL""")
def q_modulo(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 4).cast("int").alias("kind"),
                      (F.pmod("l_orderkey", F.lit(180)) >= 165).alias("in_window")).agg(F.count(F.lit(1)).alias("n"))


@register("s_round", """SELECT event_id, round(value, 1) AS r1, round(value / 7, 2) AS r2, round(value / 7, 3) AS r3
FROM events""")
def q_round(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    return e.select("event_id", F.round("value", 1).alias("r1"), F.round(F.col("value") / 7, 2).alias("r2"),
                    F.round(F.col("value") / 7, 3).alias("r3"))


@register("s_clamp", S.with_ctes(S.TELEMETRY, f"""x AS (SELECT 1)
SELECT {', '.join(KEYS)}, least(90.0, greatest(60.0, temperature)) AS temperature_clamped FROM telemetry"""))
def q_clamp(spark, sf_dir):
    t = B.telemetry(spark, sf_dir)
    return t.select(*KEYS, F.least(F.lit(90.0), F.greatest(F.lit(60.0), "temperature")).alias("temperature_clamped"))


@register("s_sin_cos", S.with_ctes(S.TELEMETRY, f"""x AS (SELECT 1)
SELECT {', '.join(KEYS)}, round(sin(k1 / 20) * 5, 6) AS temp_trend, round(cos(k1 / 15) * 0.8, 6) AS vib_trend
FROM telemetry"""))
def q_sin_cos(spark, sf_dir):
    t = B.telemetry(spark, sf_dir)
    return round_doubles(t.select(*KEYS, (F.sin(F.col("k1") / 20) * 5).alias("temp_trend"),
                                  (F.cos(F.col("k1") / 15) * 0.8).alias("vib_trend")))


@register("s_ts_format", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text FROM events""")
def q_ts_format(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
                                                   .alias("ts_text"))


@register("s_ts_add", """SELECT event_id, strftime(ts + to_hours(event_id % 24), '%Y-%m-%d %H:%M:%S') AS plus_hours,
  strftime(ts + to_days(CAST(2 * (event_id % 30) AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS plus_days FROM events""")
def q_ts_add(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    h = F.make_interval(hours=(F.col("event_id") % 24).cast("int"))
    d = F.make_interval(days=(2 * (F.col("event_id") % 30)).cast("int"))
    return e.select("event_id", F.date_format(F.col("ts") + h, "yyyy-MM-dd HH:mm:ss").alias("plus_hours"),
                    F.date_format(F.col("ts") + d, "yyyy-MM-dd HH:mm:ss").alias("plus_days"))


@register("s_now")
def q_now(spark, sf_dir):
    """Decision rows stamped with the current time (never in an oracle)."""
    d = B.decisions(spark, sf_dir)
    return d.select("event_id", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("logged_at"))


@register("s_json_in", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def q_json_in(spark, sf_dir):
    """JSON text parsed with an explicit schema; text that is no JSON gives NULL."""
    e = B.table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@register("s_json_out", S.with_ctes(S.READINGS, f"""x AS (SELECT 1)
SELECT event_id, '{{"machine_id":"' || machine_id || '","health_status":"' || {S.machine_health_sql(S.machine_risk_sql())}
  || '"}}' AS payload FROM readings"""))
def q_json(spark, sf_dir):
    """The prediction summary as JSON text (string fields, stable formatting)."""
    r = B.readings(spark, sf_dir)
    h = R.machine_health(R.machine_risk("temperature", "vibration", "pressure", "machine_id"))
    return r.select("event_id", F.to_json(F.struct("machine_id", h.alias("health_status"))).alias("payload"))


@register("s_section_label", S.with_ctes(S.CHUNKS, "x AS (SELECT 1) SELECT doc_id, section_no, source FROM chunks"))
def q_section_label(spark, sf_dir):
    return B.chunks(spark, sf_dir).select("doc_id", "section_no", "source")


@register("s_array_first", q_retrieval._EVID + """
SELECT query_id, source AS first_source FROM ev WHERE rank = 1""")
def q_array_first(spark, sf_dir):
    ev = q_retrieval.evidence(spark, sf_dir)
    lst = ev.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "source"))).alias("ev"))
    return lst.select("query_id", F.get(F.col("ev"), 0)["source"].alias("first_source"))


@register("u_concat_groups", S.with_ctes(S.TELEMETRY, """x AS (SELECT 1)
SELECT split_part(machine_id, ' #', 1) AS kind, count(*) AS n FROM telemetry GROUP BY 1"""))
def q_concat(spark, sf_dir):
    """Per-kind frames put together again: their union is the table itself, so one scan and one
    grouping do."""
    t = B.telemetry(spark, sf_dir).withColumn("kind", F.split("machine_id", " #")[0])
    return t.where(F.col("kind").isin(K.MACHINE_NAMES)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@register("u_append_reading", S.with_ctes(S.FEATURES, S.READINGS, f"""last AS (
  SELECT machine_id, ts, temperature, vibration, is_failure, 'history' AS origin FROM features
  QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, k1 DESC, k2 DESC, k3 DESC) <= 49),
live AS (SELECT machine_id, CAST(ts AS TIMESTAMP) AS ts, temperature, vibration,
           CAST({S.dashboard_risk_sql()} > 0.6 AS INTEGER) AS is_failure, 'live' AS origin FROM readings)
SELECT origin, count(*) AS n, CAST(sum(is_failure) AS BIGINT) AS n_failure, round(avg(temperature), 6) AS mean_temp
FROM (SELECT * FROM last UNION ALL SELECT * FROM live) GROUP BY origin"""))
def q_append(spark, sf_dir):
    """Last 49 readings per machine plus arriving live readings, whose rolling columns
    are missing (unionByName with allowMissingColumns)."""
    w = Window.partitionBy("machine_id").orderBy(*[F.col(c).desc() for c in ["ts", "k1", "k2", "k3"]])
    hist = featured(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 49") \
        .select("machine_id", "ts", "temperature", "vibration", "is_failure", "temp_roll_mean_6h") \
        .withColumn("origin", F.lit("history"))
    r = B.readings(spark, sf_dir)
    live = r.select("machine_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "temperature", "vibration",
                    R.threshold_class(R.dashboard_risk("temperature", "vibration", "pressure"), 0.6)
                    .alias("is_failure"), F.lit("live").alias("origin"))
    both = hist.unionByName(live, allowMissingColumns=True)
    return round_doubles(both.groupBy("origin").agg(F.count(F.lit(1)).alias("n"),
                                                    F.sum("is_failure").cast("long").alias("n_failure"),
                                                    F.avg("temperature").alias("mean_temp")))
