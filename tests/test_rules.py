"""Golden values worked out by hand from the rule formulas (FIXTURES.md section 4)."""

import pytest
from pyspark.sql import functions as F

from shopfloor.functions import rules as R
from shopfloor.operators import decisions as D
from shopfloor.operators import scenarios as SC


def _one(spark, cols, **vals):
    df = spark.createDataFrame([tuple(vals.values())], list(vals.keys()))
    return df.select(*cols).first()


@pytest.mark.parametrize("t,v,p,dash,dash_band,mach,mach_band,hyd,hyd_band", [
    (88.5, 4.8, 125.0, 0.615, "WARNING", 0.806, "CRITICAL", 0.506, "WARNING"),
    (62.0, 1.8, 98.0, 0.05, "HEALTHY", 0.35, "WARNING", 0.05, "HEALTHY"),
    (86.5, 4.6, 105.0, 0.345, "HEALTHY", 0.736, "CRITICAL", 0.436, "WARNING"),
    (60.0, 1.8, 30.0, 0.25, "HEALTHY", 0.05, "HEALTHY", 0.35, "WARNING"),
])
def test_risk_goldens(spark, t, v, p, dash, dash_band, mach, mach_band, hyd, hyd_band):
    r = _one(spark, [
        R.dashboard_risk("t", "v", "p").alias("d"),
        R.dashboard_health(R.dashboard_risk("t", "v", "p")).alias("db"),
        R.machine_risk("t", "v", "p", F.lit("MCH-01 CNC Mill")).alias("m"),
        R.machine_health(R.machine_risk("t", "v", "p", F.lit("MCH-01 CNC Mill"))).alias("mb"),
        R.machine_risk("t", "v", "p", F.lit("MCH-02 Hydraulic Press")).alias("h"),
        R.machine_health(R.machine_risk("t", "v", "p", F.lit("MCH-02 Hydraulic Press"))).alias("hb"),
    ], t=t, v=v, p=p)
    assert (r.d, r.db, r.m, r.mb, r.h, r.hb) == (dash, dash_band, mach, mach_band, hyd, hyd_band)


@pytest.mark.parametrize("p,cont,reduce,best", [
    (0.05, (0.3, 33, 2262.00), (288, 13260.00), "Continue Operation (Status Quo)"),
    (0.25, (1.4, 168, 11310.00), (288, 14460.00), "Continue Operation (Status Quo)"),
    (0.26, (1.5, 174, 11762.40), (288, 14520.00), "Reroute to Backup Line"),
    (0.88, (4.9, 591, 39811.20), (288, 18240.00), "Reroute to Backup Line"),
])
def test_scenario_goldens(spark, p, cont, reduce, best):
    df = spark.createDataFrame([(1, p)], "id int, p double")
    rows = {r.scenario_id: r for r in SC.scenarios(df, "p", ["id"]).collect()}
    s1, s2, s3, s4 = rows["SCENARIO_1"], rows["SCENARIO_2"], rows["SCENARIO_3"], rows["SCENARIO_4"]
    assert (s1.downtime_hours, s1.units_lost, s1.estimated_financial_loss) == cont
    assert (s3.units_lost, s3.estimated_financial_loss) == reduce
    assert (s2.downtime_hours, s2.units_lost, s2.failure_risk_pct, s2.estimated_financial_loss) == (2.5, 300, 5.0, 14875.0)
    assert (s4.downtime_hours, s4.units_lost, s4.failure_risk_pct, s4.estimated_financial_loss) == (1.0, 246, 2.0, 11670.0)
    assert df.select(SC.best_scenario("p").alias("b")).first().b == best


def test_incident_goldens(spark):
    from shopfloor.functions.constants import INCIDENT_TEMPLATES
    df = spark.createDataFrame([(t[0],) for t in INCIDENT_TEMPLATES], "text string")
    got = [r.urgency_level for r in df.select(*R.incident_class("text")).collect()]
    assert got == ["High", "Critical", "Low", "Medium", "High", "Critical"]
    assert df.select(R.incident_class("text")[1]).collect()[2][0] == "Drive Belt Tension Slippage"


@pytest.mark.parametrize("p,sev,rec,prio", [
    (0.61, None, "EMERGENCY_SHUTDOWN_AND_MAINTENANCE", "URGENT"),
    (0.10, "Critical", "EMERGENCY_SHUTDOWN_AND_MAINTENANCE", "URGENT"),
    (0.31, None, "REDUCE_LOAD_AND_INSPECT", "HIGH"),
    (0.10, "Moderate", "REDUCE_LOAD_AND_INSPECT", "HIGH"),
    (0.30, None, "CONTINUE_NORMAL_OPERATION", "LOW"),
])
def test_decision_matrix(spark, p, sev, rec, prio):
    df = spark.createDataFrame([(p, sev)], "p double, sev string")
    r = df.select(*R.decision_matrix("p", "sev", F.lit("M1"), F.lit("S1"))).first()
    assert (r.final_recommendation, r.priority) == (rec, prio)


def test_learning_runs_measure_the_log(spark):
    import datetime
    kinds = ["APPROVE", "REJECT", "APPROVE", "MODIFY"]
    log = spark.createDataFrame([(datetime.datetime(2026, 1, 1, i), i, k) for i, k in enumerate(kinds)],
                                "ts timestamp, event_id long, decision_type string")
    got = {r.feedback_rows: r for r in D.learning_runs(log).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert (got[3].approve_rate, got[3].reject_rate, got[3].modify_rate, got[3].run_name) == (0.6667, 0.3333, 0.0, "Retraining_Iter_4")
    assert (got[4].n_estimators, got[4].feedback_batch_size) == (140, 4)


def test_explanation_sentence(spark):
    df = spark.createDataFrame([(0.88, 86.5, 4.6, None), (0.1, 60.0, 2.0, 100.0)],
                               "p double, t double, v double, pr double")
    out = [r[0] for r in df.select(R.explanation_sentence("p", "t", "v", "pr")).collect()]
    assert out[0] == ("Failure Risk Confidence: 88.0%. Primary Drivers: Vibration (4.6 mm/s) is +84% above "
                      "normal baseline; Operating temperature (86.5°C) exceeds warning threshold of 80°C.")
    assert out[1].startswith("Model Confidence: 90.0% Normal.")


def test_surface_never_normal(spark):
    df = spark.createDataFrame([(1.0, 0.0, 10.0), (1.5, 0.0, 10.0), (1.0, 0.02, 10.0), (1.0, 0.05, 10.0)],
                               "h double, e double, g double")
    out = [tuple(r) for r in df.select(*R.surface_verdict("h", "e", "g")).collect()]
    assert out == [("Crack", 0.91, "Moderate"), ("Overheat", 0.89, "Critical"),
                   ("Scratch", 0.87, "Moderate"), ("Crack", 0.96, "Critical")]


def test_shown_values_on_rounding_ties(spark):
    """Values stored just below a tie read like the six-decimal value they stand for."""
    from shopfloor.plans.q_decisions import _shown
    df = spark.createDataFrame([(59.505,), (58.645,), (2.675,), (-0.125,), (None,)], "v double")
    assert [r[0] for r in df.select(_shown(F.col("v"), 2)).collect()] == [59.51, 58.65, 2.68, -0.13, None]
