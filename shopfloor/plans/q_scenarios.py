"""Registered queries: what-if scenario costs for every reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopfloor.functions import constants as K
from shopfloor.functions import rules as R
from shopfloor.functions.constants import PlantCosts
from shopfloor.operators import asof
from shopfloor.operators import scenarios as SC
from shopfloor.plans import sqltext as S
from shopfloor.plans.registry import register, round_doubles
from shopfloor.sources import bindings as B

_C = PlantCosts()


def _prob_readings(spark, sf_dir):
    r = B.readings(spark, sf_dir)
    return r.select("event_id", "machine_id",
                    R.dashboard_risk("temperature", "vibration", "pressure").alias("p"))


def _scenario_sql() -> str:
    (i1, n1, d1), (i2, n2, d2), (i3, n3, d3), (i4, n4, d4) = K.SCENARIOS
    c = _C
    down1 = f"{c.shift_hours!r} * p * {K.CONTINUE_DOWNTIME_FACTOR!r}"
    units1 = f"({down1}) * {c.hourly_rate!r}"
    loss1 = f"({units1}) * {c.unit_revenue!r} + p * {c.failure_cost!r}"
    units2 = K.SHUTDOWN_HOURS * c.hourly_rate
    loss2 = units2 * c.unit_revenue + K.SHUTDOWN_HOURS * c.maintenance_per_hour + K.SHUTDOWN_RESIDUAL_RISK * c.failure_cost
    units3 = (c.hourly_rate - c.hourly_rate * K.REDUCED_RATE_FACTOR) * c.shift_hours
    risk3 = f"p * {K.REDUCED_RISK_FACTOR!r}"
    loss3 = f"CAST({units3 * c.unit_revenue!r} AS DOUBLE) + {risk3} * {c.failure_cost!r}"
    h4 = K.REROUTE_SETUP_HOURS
    units4 = h4 * c.hourly_rate + (c.hourly_rate - c.hourly_rate * K.REROUTE_RATE_FACTOR) * (c.shift_hours - h4)
    loss4 = units4 * c.unit_revenue + K.REROUTE_RESIDUAL_RISK * c.failure_cost + K.REROUTE_SETUP_COST

    def row(i, n, d, down, units, risk, loss, level):
        return (f"SELECT event_id, machine_id, p, '{i}' AS scenario_id, '{n}' AS name, '{d}' AS description, "
                f"round(CAST({down} AS DOUBLE), 1) AS downtime_hours, CAST({units} AS BIGINT) AS units_lost, "
                f"round(CAST({risk} AS DOUBLE) * 100, 1) AS failure_risk_pct, "
                f"round(CAST({loss} AS DOUBLE), 2) AS estimated_financial_loss, {level} AS risk_level FROM s")

    return " UNION ALL ".join([
        row(i1, n1, d1, down1, f"floor({units1})", "p", loss1,
            f"CASE WHEN p > {K.CONTINUE_CRITICAL_ABOVE!r} THEN 'CRITICAL' ELSE 'HIGH' END"),
        row(i2, n2, d2, K.SHUTDOWN_HOURS, int(units2), K.SHUTDOWN_RESIDUAL_RISK, loss2, "'LOW'"),
        row(i3, n3, d3, 0.0, int(units3), risk3, loss3, "'MODERATE'"),
        row(i4, n4, d4, h4, int(units4), K.REROUTE_RESIDUAL_RISK, loss4, "'LOW'"),
    ])


_BASE = S.with_ctes(S.READINGS, f"""s AS (SELECT event_id, machine_id, {S.dashboard_risk_sql()} AS p FROM readings),
sc AS ({_scenario_sql()})""")
_COLS = ["event_id", "scenario_id", "name", "description", "downtime_hours", "units_lost", "failure_risk_pct",
         "estimated_financial_loss", "risk_level"]


def _all(spark, sf_dir):
    return SC.scenarios(_prob_readings(spark, sf_dir), "p", ["event_id"], _C)


@register("j_scenarios", _BASE + f" SELECT {', '.join(_COLS)} FROM sc")
def q_scenarios(spark, sf_dir):
    """Every reading x 4 scenarios, generated in-row (no join)."""
    return round_doubles(_all(spark, sf_dir).select(*_COLS))


for _i, _key in enumerate(["sc_continue", "sc_shutdown", "sc_reduce", "sc_reroute"]):
    _sid = K.SCENARIOS[_i][0]

    def _q(spark, sf_dir, _sid=_sid):
        return round_doubles(_all(spark, sf_dir).where(F.col("scenario_id") == _sid).select(*_COLS))

    register(_key, _BASE + f" SELECT {', '.join(_COLS)} FROM sc WHERE scenario_id = '{_sid}'")(_q)

_SEL = ["event_id", "name", "description", "downtime_hours", "units_lost", "failure_risk_pct",
        "estimated_financial_loss", "risk_level"]


@register("p_select_scenario_cols", _BASE + f" SELECT {', '.join(_SEL)} FROM sc")
def q_select_cols(spark, sf_dir):
    return round_doubles(_all(spark, sf_dir).select(*_SEL))


@register("t_best_scenario", _BASE + """
SELECT event_id, name AS best_scenario FROM sc
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY estimated_financial_loss, scenario_id) = 1""")
def q_best(spark, sf_dir):
    """Cheapest scenario per reading, chosen inside the row: no shuffle."""
    r = _prob_readings(spark, sf_dir)
    return r.select("event_id", SC.best_scenario("p", _C).alias("best_scenario"))


@register("w_scenario_rank", _BASE + """
SELECT event_id, scenario_id, name, estimated_financial_loss,
  row_number() OVER (PARTITION BY event_id ORDER BY estimated_financial_loss, scenario_id) AS scenario_rank
FROM sc""")
def q_rank(spark, sf_dir):
    r = _prob_readings(spark, sf_dir)
    return round_doubles(SC.ranked_scenarios(r, "p", ["event_id"], _C).withColumn(
        "scenario_rank", F.col("scenario_rank").cast("long")))


@register("src_inline_rows", _BASE + """
SELECT name, count(*) AS n_readings, round(sum(estimated_financial_loss), 2) AS total_loss FROM sc GROUP BY name""")
def q_inline(spark, sf_dir):
    """The scenario table as literal rows, expanded over every reading and aggregated."""
    return round_doubles(_all(spark, sf_dir).groupBy("name").agg(
        F.count(F.lit(1)).alias("n_readings"), F.round(F.sum("estimated_financial_loss"), 2).alias("total_loss")))


_MACHINE_COSTS = S.with_ctes(S.READINGS, f"""cp AS (
  SELECT {S._machine('s_suppkey', 's_suppkey')} AS machine_id, TIMESTAMP '2024-01-01' AS a, TIMESTAMP '2024-01-15' AS b,
    100.0 + s_suppkey % 50 AS rate, 40.0 + s_nationkey AS revenue, NULL AS failure FROM supplier
  UNION ALL SELECT {S._machine('s_suppkey', 's_suppkey')}, TIMESTAMP '2024-01-15',
    CASE WHEN s_suppkey % 5 = 0 THEN TIMESTAMP '2024-01-25' END, 80.0 + s_suppkey % 90, 45.0, 9000.0 + s_suppkey * 10 FROM supplier),
s AS (SELECT r.event_id, {S.dashboard_risk_sql()} AS p, CAST(coalesce(rate, {_C.hourly_rate}) AS DOUBLE) AS rate,
    CAST(coalesce(revenue, {_C.unit_revenue}) AS DOUBLE) AS revenue, CAST(coalesce(failure, {_C.failure_cost}) AS DOUBLE) AS failure
  FROM readings r LEFT JOIN cp ON cp.machine_id = r.machine_id AND r.ts >= cp.a AND (cp.b IS NULL OR r.ts < cp.b)),
u AS (SELECT *, CAST({_C.shift_hours} AS DOUBLE) * p * CAST({K.CONTINUE_DOWNTIME_FACTOR} AS DOUBLE) * rate AS u1,
    CAST({K.SHUTDOWN_HOURS} AS DOUBLE) * rate AS u2,
    (rate - rate * CAST({K.REDUCED_RATE_FACTOR} AS DOUBLE)) * CAST({_C.shift_hours} AS DOUBLE) AS u3,
    CAST({K.REROUTE_SETUP_HOURS} AS DOUBLE) * rate + (rate - rate * CAST({K.REROUTE_RATE_FACTOR} AS DOUBLE))
      * CAST({_C.shift_hours - K.REROUTE_SETUP_HOURS} AS DOUBLE) AS u4 FROM s),
l AS (SELECT event_id, unnest(['{"', '".join(x[0] for x in K.SCENARIOS)}']) AS scenario_id,
    unnest([u1 * revenue + p * failure,
      u2 * revenue + CAST({K.SHUTDOWN_HOURS * _C.maintenance_per_hour} AS DOUBLE) + CAST({K.SHUTDOWN_RESIDUAL_RISK} AS DOUBLE) * failure,
      u3 * revenue + p * CAST({K.REDUCED_RISK_FACTOR} AS DOUBLE) * failure,
      u4 * revenue + CAST({K.REROUTE_RESIDUAL_RISK} AS DOUBLE) * failure + CAST({K.REROUTE_SETUP_COST} AS DOUBLE)]) AS loss FROM u)
SELECT event_id, scenario_id, round(loss, 2) AS estimated_financial_loss FROM l""")


@register("sc_machine_costs", _MACHINE_COSTS)
def q_machine_costs(spark, sf_dir):
    """Scenario losses with the cost parameters that held for the machine when the reading was taken."""
    fields = ["hourly_rate", "unit_revenue", "failure_cost"]
    r = B.readings(spark, sf_dir).select("event_id", "machine_id", "ts", R.dashboard_risk("temperature", "vibration", "pressure").alias("p"))
    costed = asof.as_of_join(r, B.cost_parameters(spark, sf_dir), "machine_id", "ts", {f: getattr(_C, f) for f in fields})
    return round_doubles(SC.scenarios(costed, "p", ["event_id"], SC.row_costs(**{f: f for f in fields}))
                         .select("event_id", "scenario_id", "estimated_financial_loss"))
