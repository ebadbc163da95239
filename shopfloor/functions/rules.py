"""Column-returning rules. Each takes Columns and returns a Column, so the same
rule runs in a batch select, a streaming select or a SQL expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopfloor.functions import constants as K
from shopfloor.functions.constants import DashboardRisk, MachineRisk


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- generator rules -------------------------------------------------------

def baseline_level(machine, table, other) -> Column:
    """Normal level chosen by machine-name substring (first match wins)."""
    m = _c(machine)
    expr = None
    for needle, level in table:
        cond = m.contains(needle)
        expr = F.when(cond, F.lit(level)) if expr is None else expr.when(cond, F.lit(level))
    return expr.otherwise(F.lit(other))


def in_anomaly_window(i) -> Column:
    return (F.pmod(_c(i), F.lit(K.ANOMALY_PERIOD))).between(K.ANOMALY_START, K.ANOMALY_PERIOD - 1)


def failure_label(i, temperature, vibration) -> Column:
    """1 inside the anomaly window when temperature or vibration is over the limit."""
    hit = in_anomaly_window(i) & (
        (_c(temperature) > K.FAILURE_TEMPERATURE) | (_c(vibration) > K.FAILURE_VIBRATION))
    return F.when(hit, F.lit(1)).otherwise(F.lit(0))


def failure_type(label) -> Column:
    return F.when(_c(label) == 1, F.lit(K.FAILURE_TYPE))


def quality_score(defects, units) -> Column:
    ratio = F.try_divide(_c(defects).cast("double"), F.nullif(_c(units), F.lit(0)).cast("double"))
    return F.round(F.greatest(F.lit(0.0), F.lit(100.0) - ratio * 100.0), 1)


# --- risk rules --------------------------------------------------------------

def dashboard_risk(temperature, vibration, pressure, p: DashboardRisk = DashboardRisk()) -> Column:
    t, v, pr = _c(temperature), _c(vibration), _c(pressure)
    score = (F.lit(p.base)
             + F.when(t > p.temp_limit, (t - p.temp_limit) * p.temp_slope).otherwise(F.lit(0.0))
             + F.when(v > p.vib_limit, (v - p.vib_limit) * p.vib_slope).otherwise(F.lit(0.0))
             + F.when((pr > p.press_high) | (pr < p.press_low), F.lit(p.press_add)).otherwise(F.lit(0.0)))
    return F.round(F.least(F.lit(p.ceiling), F.greatest(F.lit(p.floor), score)), 3)


def dashboard_health(prob, p: DashboardRisk = DashboardRisk()) -> Column:
    x = _c(prob)
    return (F.when(x > p.critical, F.lit("CRITICAL"))
            .when(x > p.warning, F.lit("WARNING")).otherwise(F.lit("HEALTHY")))


def sensor_alerts(temperature, vibration, pressure, p: DashboardRisk = DashboardRisk()) -> list[Column]:
    t, v, pr = _c(temperature), _c(vibration), _c(pressure)
    return [
        F.coalesce(t > p.alert_temp, F.lit(False)).alias("temp_alert"),
        F.coalesce(v > p.vib_limit, F.lit(False)).alias("vib_alert"),
        F.coalesce((pr < p.press_low) | (pr > p.press_high), F.lit(False)).alias("press_alert"),
    ]


def machine_risk(temperature, vibration, pressure, machine, p: MachineRisk = MachineRisk()) -> Column:
    t, v, pr, m = _c(temperature), _c(vibration), _c(pressure), _c(machine)
    temp_risk = F.when(t > p.temp_limit, (t - p.temp_limit) / p.temp_span).otherwise(F.lit(0.0))
    vib_risk = F.when(v > p.vib_limit, (v - p.vib_limit) / p.vib_span).otherwise(F.lit(0.0))
    press_out = F.when(m.contains("Hydraulic"), (pr < p.hydraulic_low) | (pr > p.hydraulic_high)) \
        .otherwise(pr > p.other_high)
    press_risk = F.when(press_out, F.lit(p.press_add)).otherwise(F.lit(0.0))
    total = F.lit(p.base) + temp_risk * p.temp_weight + vib_risk * p.vib_weight + press_risk
    return F.round(F.least(F.lit(p.ceiling), F.greatest(F.lit(p.floor), total)), 3)


def machine_health(prob, p: MachineRisk = MachineRisk()) -> Column:
    x = _c(prob)
    return (F.when(x > p.critical, F.lit("CRITICAL"))
            .when(x > p.warning, F.lit("WARNING")).otherwise(F.lit("HEALTHY")))


def payload_defaults(temperature, vibration, pressure, machine) -> list[Column]:
    return [
        F.coalesce(_c(temperature), F.lit(K.DEFAULT_TEMPERATURE)).alias("temperature"),
        F.coalesce(_c(vibration), F.lit(K.DEFAULT_VIBRATION)).alias("vibration"),
        F.coalesce(_c(pressure), F.lit(K.DEFAULT_PRESSURE)).alias("pressure"),
        F.coalesce(_c(machine), F.lit(K.DEFAULT_MACHINE)).alias("machine_id"),
    ]


def threshold_class(prob, threshold: float = 0.5) -> Column:
    return (_c(prob) > threshold).cast("int")


# --- decisions ---------------------------------------------------------------

def _template(tpl: str, machine: Column, source: Column) -> Column:
    """Fill ``{m}``/``{s}`` placeholders of a fixed sentence."""
    parts: list[Column] = []
    rest = tpl
    while rest:
        i_m, i_s = rest.find("{m}"), rest.find("{s}")
        idx = [i for i in (i_m, i_s) if i >= 0]
        if not idx:
            parts.append(F.lit(rest))
            break
        i = min(idx)
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(machine if i == i_m else source)
        rest = rest[i + 3:]
    return F.concat(*parts)


def decision_matrix(prob, severity, machine, top_source) -> list[Column]:
    """Recommendation, priority and action sentence from risk and vision severity."""
    p, sev = _c(prob), F.coalesce(_c(severity), F.lit("None"))
    m = F.coalesce(_c(machine), F.lit(K.DEFAULT_MACHINE))
    s = F.coalesce(_c(top_source), F.lit("SOP Manual"))
    urgent = (p > 0.60) | (sev == "Critical")
    high = (p > 0.30) | (sev == "Moderate")

    def pick(i):
        vals = [K.DECISION_URGENT[i], K.DECISION_HIGH[i], K.DECISION_LOW[i]]
        if i == 2:
            vals = [_template(v, m, s) for v in vals]
        else:
            vals = [F.lit(v) for v in vals]
        return F.when(urgent, vals[0]).when(high, vals[1]).otherwise(vals[2])

    return [pick(0).alias("final_recommendation"), pick(1).alias("priority"),
            pick(2).alias("action_summary")]


def contributing_agents() -> Column:
    return F.array(*[F.lit(a) for a in K.AGENT_NAMES])


# --- incident text -------------------------------------------------------------

def _contains_any(lowered: Column, words: list[str]) -> Column:
    cond = None
    for w in words:
        c = lowered.contains(w)
        cond = c if cond is None else (cond | c)
    return cond


def incident_class(text) -> list[Column]:
    """Urgency and failure mode: the first keyword group with a substring hit wins."""
    low = F.lower(_c(text))
    urg = fm = None
    for urgency, mode, words in K.INCIDENT_RULES:
        cond = _contains_any(low, words)
        urg = F.when(cond, F.lit(urgency)) if urg is None else urg.when(cond, F.lit(urgency))
        fm = F.when(cond, F.lit(mode)) if fm is None else fm.when(cond, F.lit(mode))
    return [urg.otherwise(F.lit(K.INCIDENT_DEFAULT[0])).alias("urgency_level"),
            fm.otherwise(F.lit(K.INCIDENT_DEFAULT[1])).alias("detected_failure_mode")]


def incident_action(urgency) -> Column:
    pairs = []
    for k, v in K.INCIDENT_ACTIONS.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), _c(urgency))


# --- surface verdict -------------------------------------------------------------

def surface_verdict(heat_ratio, edge_density, grey_range) -> list[Column]:
    h, e, g = _c(heat_ratio), _c(edge_density), _c(grey_range)
    overheat = h > K.HEAT_RATIO_LIMIT
    marked = (e > K.EDGE_DENSITY_LOW) | (g > K.GREY_RANGE_LOW)
    crack = (e > K.EDGE_DENSITY_HIGH) | (g > K.GREY_RANGE_HIGH)
    defect = (F.when(overheat, F.lit("Overheat")).when(marked & crack, F.lit("Crack"))
              .when(marked, F.lit("Scratch")).otherwise(F.lit("Crack")))
    conf = (F.when(overheat, F.least(F.lit(0.98), F.round(F.lit(0.88) + (h - 1.4) * 0.1, 3)))
            .when(marked & crack, F.least(F.lit(0.96), F.round(F.lit(0.86) + e * 2.0, 3)))
            .when(marked, F.round(F.lit(0.84) + e * 1.5, 3))
            .otherwise(F.lit(0.91)))
    sev = (F.when(overheat, F.lit("Critical")).when(marked & crack, F.lit("Critical"))
           .otherwise(F.lit("Moderate")))
    return [defect.alias("defect_type"), conf.alias("confidence"), sev.alias("severity")]


# --- explanation text ------------------------------------------------------------

def _num_text(x: Column) -> Column:
    return x.cast("double").cast("string")


def explanation_sentence(prob, temperature, vibration, pressure) -> Column:
    """Reasons over thresholds joined by '; ', else a normal-confidence sentence."""
    t = F.coalesce(_c(temperature), F.lit(K.EXPLAIN_DEFAULT_TEMPERATURE))
    v = F.coalesce(_c(vibration), F.lit(K.EXPLAIN_DEFAULT_VIBRATION))
    pr = F.coalesce(_c(pressure), F.lit(K.EXPLAIN_DEFAULT_PRESSURE))
    p = _c(prob)
    vib_reason = F.when(v > 3.5, F.concat(
        F.lit("Vibration ("), _num_text(v), F.lit(" mm/s) is +"),
        F.format_string("%.0f", (v - 2.5) / 2.5 * 100), F.lit("% above normal baseline")))
    temp_reason = F.when(t > 80.0, F.concat(
        F.lit("Operating temperature ("), _num_text(t), F.lit("°C) exceeds warning threshold of 80°C")))
    press_reason = F.when((pr > 120.0) | (pr < 85.0), F.concat(
        F.lit("Hydraulic pressure ("), _num_text(pr), F.lit(" bar) is outside optimal 90-110 bar window")))
    reasons = F.concat_ws("; ", vib_reason, temp_reason, press_reason)
    return (F.when(reasons == "", F.concat(
        F.lit("Model Confidence: "), F.format_string("%.1f", F.lit(100.0) - p * 100),
        F.lit("% Normal. All sensor telemetry signals remain within healthy operational limits.")))
        .otherwise(F.concat(F.lit("Failure Risk Confidence: "), F.format_string("%.1f", p * 100),
                            F.lit("%. Primary Drivers: "), reasons, F.lit("."))))
