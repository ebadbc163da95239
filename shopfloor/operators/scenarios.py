"""What-if scenario costs per reading.

The four scenarios are generated inside each row (``inline`` of an array of
structs), so there is no join and no shuffle: every reading gets its 4 rows in
the task that read it. The cheapest scenario and the ranking are computed on the
same in-row array (``array_min`` / ``array_sort``), again without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.functions import constants as K
from shopfloor.functions.constants import PlantCosts

SCENARIO_FIELDS = ["scenario_id", "name", "description", "downtime_hours", "units_lost",
                   "failure_risk_pct", "estimated_financial_loss", "risk_level"]


def _row(sid: str, name: str, desc: str, downtime: Column, units: Column, risk: Column,
         loss: Column, level: Column) -> Column:
    return F.struct(
        F.lit(sid).alias("scenario_id"), F.lit(name).alias("name"), F.lit(desc).alias("description"),
        F.round(downtime, 1).alias("downtime_hours"), units.cast("long").alias("units_lost"),
        F.round(risk * 100, 1).alias("failure_risk_pct"),
        F.round(loss, 2).alias("estimated_financial_loss"), level.alias("risk_level"))


def row_costs(**columns: str) -> PlantCosts:
    """Costs read from columns of the row (field name -> column); the other fields keep their defaults."""
    return PlantCosts(**{field: F.col(c) for field, c in columns.items()})


def _value(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def scenario_array(prob: str | Column, c: PlantCosts = PlantCosts()) -> Column:
    """Array of the 4 scenario structs for failure probability ``prob``. The costs are numbers, or columns
    (``row_costs``) where they differ from row to row."""
    p = F.col(prob) if isinstance(prob, str) else prob
    (i1, n1, d1), (i2, n2, d2), (i3, n3, d3), (i4, n4, d4) = K.SCENARIOS
    # 1 continue: expected breakdown midway through the shift
    down1 = _value(c.shift_hours) * p * K.CONTINUE_DOWNTIME_FACTOR
    units1 = down1 * c.hourly_rate
    loss1 = units1 * c.unit_revenue + p * c.failure_cost
    lvl1 = F.when(p > K.CONTINUE_CRITICAL_ABOVE, F.lit("CRITICAL")).otherwise(F.lit("HIGH"))
    # 2 planned shutdown (constant)
    down2 = K.SHUTDOWN_HOURS
    units2 = down2 * c.hourly_rate
    loss2 = units2 * c.unit_revenue + down2 * c.maintenance_per_hour + K.SHUTDOWN_RESIDUAL_RISK * c.failure_cost
    # 3 reduce load
    reduced = c.hourly_rate * K.REDUCED_RATE_FACTOR
    units3 = (c.hourly_rate - reduced) * c.shift_hours
    risk3 = p * K.REDUCED_RISK_FACTOR
    loss3 = _value(units3 * c.unit_revenue) + risk3 * c.failure_cost
    # 4 reroute (constant)
    down4 = K.REROUTE_SETUP_HOURS
    units4 = down4 * c.hourly_rate + (c.hourly_rate - c.hourly_rate * K.REROUTE_RATE_FACTOR) * (c.shift_hours - down4)
    loss4 = units4 * c.unit_revenue + K.REROUTE_RESIDUAL_RISK * c.failure_cost + K.REROUTE_SETUP_COST
    return F.array(
        _row(i1, n1, d1, down1, F.floor(units1), p, loss1, lvl1),
        _row(i2, n2, d2, F.lit(down2), _value(units2), F.lit(K.SHUTDOWN_RESIDUAL_RISK), _value(loss2),
             F.lit("LOW")),
        _row(i3, n3, d3, F.lit(0.0), _value(units3), risk3, loss3, F.lit("MODERATE")),
        _row(i4, n4, d4, F.lit(down4), _value(units4), F.lit(K.REROUTE_RESIDUAL_RISK), _value(loss4),
             F.lit("LOW")),
    )


def scenarios(df: DataFrame, prob: str, keep: list[str], c: PlantCosts = PlantCosts()) -> DataFrame:
    """One row per (input row, scenario)."""
    return df.select(*keep, F.inline(scenario_array(prob, c)))


def _ordered(arr: Column) -> Column:
    return F.array_sort(F.transform(arr, lambda s: F.struct(
        s["estimated_financial_loss"].alias("loss"), s["scenario_id"].alias("sid"), s["name"].alias("name"))))


def best_scenario(prob: str, c: PlantCosts = PlantCosts()) -> Column:
    """Name of the cheapest scenario (ties: lower scenario id)."""
    return F.element_at(_ordered(scenario_array(prob, c)), 1)["name"]


def ranked_scenarios(df: DataFrame, prob: str, keep: list[str], c: PlantCosts = PlantCosts()) -> DataFrame:
    """(keep..., scenario_id, name, loss, rank) with rank 1 = cheapest."""
    out = df.select(*keep, F.posexplode(_ordered(scenario_array(prob, c))).alias("pos", "s"))
    return out.select(*keep, F.col("s.sid").alias("scenario_id"), F.col("s.name").alias("name"),
                      F.col("s.loss").alias("estimated_financial_loss"), (F.col("pos") + 1).alias("scenario_rank"))
