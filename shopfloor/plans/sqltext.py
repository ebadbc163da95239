"""SQL text of the bindings and shared steps, for the independent DuckDB oracle.

These are written from the same definitions as ``shopfloor.sources.bindings``
and ``shopfloor.operators``, but as plain ANSI SQL over the raw driver tables.
"""

from __future__ import annotations

from shopfloor.functions import constants as K


def _machine(kind_key: str, serial: str) -> str:
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(K.MACHINE_NAMES[:3]))
    return (f"(CASE CAST({kind_key} % 4 AS INTEGER) {names} ELSE '{K.MACHINE_NAMES[3]}' END"
            f" || ' #' || CAST({serial} AS VARCHAR))")


TELEMETRY = f"""telemetry AS (
  SELECT l_shipdate AS ts, {_machine('l_suppkey', 'l_suppkey')} AS machine_id,
    l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3,
    CASE WHEN l_orderkey % 499 = 0 THEN CAST(999.0 AS DOUBLE) ELSE 50.0 + l_quantity END AS temperature,
    CASE WHEN l_partkey % 101 = 0 THEN CAST(NULL AS DOUBLE) ELSE 1.0 + l_discount * 50 END AS vibration,
    40.0 + l_tax * 1250 AS pressure,
    1000.0 + l_extendedprice / 30 AS rpm,
    212.0 + CAST(l_partkey % 17 AS DOUBLE) AS voltage,
    CAST((50.0 + l_quantity > 88.0) OR (1.0 + l_discount * 50 > 5.0) AS INTEGER) AS is_failure,
    CASE WHEN (50.0 + l_quantity > 88.0) OR (1.0 + l_discount * 50 > 5.0)
         THEN 'Overheating/Vibration' END AS failure_type
  FROM lineitem)"""

SENSORS = K.SENSOR_COLUMNS
CAPPED = K.CAPPED_COLUMNS

_med = ", ".join(f"median({c}) AS med_{c}" for c in SENSORS)
_imp = ", ".join(f"coalesce(t.{c}, st.med_{c}) AS {c}" for c in SENSORS)
_q = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in CAPPED)
_b = ", ".join(f"q1_{c} - (q3_{c} - q1_{c}) * {K.IQR_FACTOR} AS lo_{c}, "
               f"q3_{c} + (q3_{c} - q1_{c}) * {K.IQR_FACTOR} AS hi_{c}" for c in CAPPED)
_cap = ", ".join(
    f"greatest(lo_{c}, least(hi_{c}, {c})) AS {c}" if c in CAPPED else c for c in SENSORS)

CLEANED = TELEMETRY + f""",
st AS (SELECT {_med} FROM telemetry),
imputed AS (SELECT t.ts, t.machine_id, t.k1, t.k2, t.k3, {_imp}, t.is_failure, t.failure_type
            FROM telemetry t, st),
qs AS (SELECT {_q} FROM imputed),
bnd AS (SELECT {_b} FROM qs),
capped AS (SELECT ts, machine_id, k1, k2, k3, {_cap}, is_failure, failure_type FROM imputed, bnd)"""

_W = "PARTITION BY machine_id ORDER BY ts, k1, k2, k3"


def _roll(k: int) -> str:
    f = f"OVER ({_W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return (f"avg(temperature) {f} AS temp_roll_mean_{k}h, "
            f"coalesce(stddev_samp(temperature) {f}, 0.0) AS temp_roll_std_{k}h, "
            f"avg(vibration) {f} AS vib_roll_mean_{k}h, "
            f"max(vibration) {f} AS vib_roll_max_{k}h, "
            f"avg(pressure) {f} AS press_roll_mean_{k}h")


def fill_sql(col: str, alias: str) -> str:
    return (f"coalesce(last_value({col} IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING "
            f"AND CURRENT ROW), first_value({col} IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW "
            f"AND UNBOUNDED FOLLOWING)) AS {alias}")


FEATURES = CLEANED + f""",
features AS (
  SELECT ts, machine_id, k1, k2, k3, {', '.join(SENSORS)}, is_failure, failure_type,
    {_roll(6)}, {_roll(24)},
    vibration * temperature AS vib_temp_interaction,
    vibration / (pressure + 1e-5) AS vib_press_ratio,
    rpm / (vibration + 1e-5) AS rpm_vib_ratio,
    {fill_sql('temperature', 'temp_lag_1')}, {fill_sql('vibration', 'vib_lag_1')}
  FROM capped WHERE machine_id IS NOT NULL)"""

FEATURE_COLUMNS = (list(SENSORS)
                   + [f"{p}_{k}h" for k in (6, 24) for p in
                      ("temp_roll_mean", "temp_roll_std", "vib_roll_mean", "vib_roll_max", "press_roll_mean")]
                   + ["vib_temp_interaction", "vib_press_ratio", "rpm_vib_ratio", "temp_lag_1", "vib_lag_1"])


def machine_risk_sql(t: str = "temperature", v: str = "vibration", p: str = "pressure",
                     m: str = "machine_id") -> str:
    total = (f"0.05 + (CASE WHEN {t} > 78.0 THEN ({t} - 78.0) / 25.0 ELSE 0.0 END) * 0.45"
             f" + (CASE WHEN {v} > 3.2 THEN ({v} - 3.2) / 3.0 ELSE 0.0 END) * 0.5"
             f" + (CASE WHEN (CASE WHEN contains({m}, 'Hydraulic') THEN ({p} < 70.0 OR {p} > 135.0)"
             f" ELSE {p} > 65.0 END) THEN 0.3 ELSE 0.0 END)")
    return f"round(least(0.98, greatest(0.04, {total})), 3)"


def machine_health_sql(p: str) -> str:
    return f"CASE WHEN {p} > 0.6 THEN 'CRITICAL' WHEN {p} > 0.3 THEN 'WARNING' ELSE 'HEALTHY' END"


def dashboard_risk_sql(t: str = "temperature", v: str = "vibration", p: str = "pressure") -> str:
    total = (f"0.05 + (CASE WHEN {t} > 80.0 THEN ({t} - 80.0) * 0.02 ELSE 0.0 END)"
             f" + (CASE WHEN {v} > 3.5 THEN ({v} - 3.5) * 0.15 ELSE 0.0 END)"
             f" + (CASE WHEN ({p} > 120.0 OR {p} < 85.0) THEN 0.2 ELSE 0.0 END)")
    return f"round(least(0.99, greatest(0.02, {total})), 3)"


def dashboard_health_sql(p: str) -> str:
    return f"CASE WHEN {p} > 0.65 THEN 'CRITICAL' WHEN {p} > 0.35 THEN 'WARNING' ELSE 'HEALTHY' END"


READINGS = f"""readings AS (
  SELECT event_id, ts, {_machine('user_id', 'user_id')} AS machine_id,
    50.0 + value / 10 AS temperature,
    1.0 + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 20 AS vibration,
    60.0 + CAST(event_id % 90 AS DOUBLE) AS pressure, event_type, user_id AS image_id
  FROM events)"""


def _tmpl_case(i: int) -> str:
    whens = " ".join(f"WHEN {j} THEN '{t[i]}'" for j, t in enumerate(K.INCIDENT_TEMPLATES))
    return f"CASE CAST(event_id % 6 AS INTEGER) {whens} END"


INCIDENTS = f"""incidents AS (
  SELECT event_id, 'LOG-' || CAST(event_id AS VARCHAR) AS log_id, ts,
    {_machine('user_id', 'user_id')} AS machine_id,
    {_tmpl_case(0)} AS incident_text, {_tmpl_case(1)} AS labelled_urgency,
    {_tmpl_case(2)} AS action_taken,
    0.5 + CAST(event_id % 76 AS DOUBLE) / 10 AS downtime_hours
  FROM events)"""

DECISIONS = """decisions AS (
  SELECT event_id, ts, event_id - event_id % 10 AS target_event_id,
    'SUP-' || CAST(user_id AS VARCHAR) AS supervisor_id,
    CASE event_type WHEN 'purchase' THEN 'APPROVE' WHEN 'error' THEN 'REJECT' WHEN 'signup' THEN 'MODIFY'
                    ELSE 'ESCALATE' END AS decision_type,
    CASE WHEN event_type = 'signup' THEN 'Reduce load by ' || json_extract_string(props, '$.k') || '%'
         WHEN event_type = 'error' THEN '' END AS notes_in
  FROM events WHERE event_type IN ('purchase', 'error', 'signup', 'view'))"""

PRODUCTION = f"""production AS (
  SELECT 'BAT-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS batch_id,
    'LINE-0' || CAST(l_suppkey % 3 + 1 AS VARCHAR) AS line_id,
    {_machine('l_suppkey', 'l_suppkey')} AS machine_id, l_shipdate AS ts,
    80 + CAST(l_quantity AS INTEGER) AS units_produced,
    CAST(floor(l_quantity * l_discount) AS INTEGER) AS defect_count,
    l_partkey % 10 AS kind
  FROM lineitem)"""

CHUNKS = """chunks AS (
  SELECT doc_id, CAST(i AS INTEGER) AS section_no,
    source || '/' || CAST(doc_id AS VARCHAR) || ' (Section ' || CAST(i AS VARCHAR) || ')' AS source,
    content
  FROM (
    SELECT doc_id, source, kept[i] AS content, i
    FROM (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)),
                 lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: length(x) > 20) AS kept
          FROM documents) d,
         LATERAL (SELECT unnest(range(1, len(kept) + 1)) AS i) r))"""

PIXELS = """pixels AS (
  SELECT vec_id AS image_id, label, CAST(pos % 8 AS INTEGER) AS x, CAST(pos // 8 AS INTEGER) AS y,
    CAST(least(255, greatest(0, floor((CAST(embedding[pos + 1] AS DOUBLE) + 0.5) * 256))) AS INTEGER) AS r,
    CAST(least(255, greatest(0, floor((CAST(embedding[(pos + 21) % 64 + 1] AS DOUBLE) + 0.5) * 256))) AS INTEGER) AS g,
    CAST(least(255, greatest(0, floor((CAST(embedding[(pos + 42) % 64 + 1] AS DOUBLE) + 0.5) * 256))) AS INTEGER) AS b
  FROM embeddings, LATERAL (SELECT unnest(range(0, 64)) AS pos) p)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().removeprefix("WITH ").strip() for c in ctes)
