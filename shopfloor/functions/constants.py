"""Parameters of the rules.

Everything below the "Fixed values" marker must equal the behaviour this
library reproduces (thresholds, keyword lists, labels, sentence templates);
change them only through the dataclass parameters, never in place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

MACHINE_NAMES = ["MCH-01 CNC Mill", "MCH-02 Hydraulic Press", "MCH-03 Robotic Arm",
                 "MCH-04 Conveyor System"]

SENSOR_COLUMNS = ["temperature", "vibration", "pressure", "rpm", "voltage"]
CAPPED_COLUMNS = ["temperature", "vibration", "pressure"]
IQR_FACTOR = 2.5
ROLLING_WINDOWS = [6, 24]
NON_FEATURE_COLUMNS = ["timestamp", "machine_id", "is_failure", "failure_type"]

# Normal levels by machine-name substring: temperature, vibration, pressure, rpm.
BASELINE_TEMPERATURE = [("CNC", 65.0), ("Hydraulic", 75.0)]
BASELINE_TEMPERATURE_OTHER = 55.0
BASELINE_VIBRATION = [("Robotic", 1.2)]
BASELINE_VIBRATION_OTHER = 2.5
BASELINE_PRESSURE = [("Hydraulic", 100.0)]
BASELINE_PRESSURE_OTHER = 30.0
BASELINE_RPM = [("CNC", 3000.0)]
BASELINE_RPM_OTHER = 1500.0

# Generator label rule: anomaly window i % 180 in [165, 180), then thresholds.
ANOMALY_PERIOD = 180
ANOMALY_START = 165
FAILURE_TEMPERATURE = 88.0
FAILURE_VIBRATION = 5.0
FAILURE_TYPE = "Overheating/Vibration"

# Payload defaults when a reading lacks a field.
DEFAULT_TEMPERATURE = 60.0
DEFAULT_VIBRATION = 1.8
DEFAULT_PRESSURE = 30.0
DEFAULT_MACHINE = "MCH-01 CNC Mill"
EXPLAIN_DEFAULT_TEMPERATURE = 70.0
EXPLAIN_DEFAULT_VIBRATION = 2.0
EXPLAIN_DEFAULT_PRESSURE = 100.0

# Incident text: ordered keyword groups, first match wins.
INCIDENT_RULES = [
    ("Critical", "Thermal Overload / Coolant Breakdown",
     ["overheat", "fire", "emergency", "code e-402", "92c", "critical", "fuse"]),
    ("High", "Mechanical Bearing/Spindle Wear",
     ["grinding", "vibration", "bearing", "jitter", "spindle"]),
    ("Medium", "Hydraulic Pressure Valve Leakage",
     ["pressure", "leak", "drop", "valve", "actuator"]),
    ("Low", "Drive Belt Tension Slippage",
     ["belt", "slippage", "routine", "minor"]),
]
INCIDENT_DEFAULT = ("Low", "Routine Inspection")
INCIDENT_ACTIONS = {
    "Critical": "Immediate emergency shutdown; execute coolant flush and replace thermal fuse.",
    "High": "Schedule Tier-2 bearing inspection within 4 operational hours; check lubricant levels.",
    "Medium": "Inspect pressure valve seal and recalibrate actuator pressure regulator.",
    "Low": "Adjust belt tension during next planned maintenance window.",
}

# Maintenance log templates: text, labelled urgency, action taken.
INCIDENT_TEMPLATES = [
    ("High vibration detected in spindle bearing. Unusual grinding noise heard during high RPM cycle.",
     "High", "Bearing Replacement Needed"),
    ("Overheating error code E-402 on hydraulic pump. Fluid temperature exceeded 92C.",
     "Critical", "Hydraulic Coolant Flush"),
    ("Routine inspection complete. Minor belt slippage noted on conveyor drive motor.",
     "Low", "Adjusted Belt Tension"),
    ("Pressure drop in main actuator line causing alignment errors on component batch.",
     "Medium", "Replaced Pressure Valve Seal"),
    ("Robotic arm joint 3 jittering during pickup motion. Calibration needed.",
     "Medium", "Recalibrated Motor Controller"),
    ("Emergency stop tripped due to thermal overload sensor triggering.",
     "Critical", "Replaced Thermal Fuse & Sensor"),
]

# Decision matrix labels and action sentences ({m} = machine, {s} = top source).
DECISION_URGENT = ("EMERGENCY_SHUTDOWN_AND_MAINTENANCE", "URGENT",
                   "Immediately halt {m}. Execute Tier-2 bearing & thermal fuse replacement per {s}.")
DECISION_HIGH = ("REDUCE_LOAD_AND_INSPECT", "HIGH",
                 "Reduce operating RPM on {m} by 30%. Schedule technician inspection within 2 hours per {s}.")
DECISION_LOW = ("CONTINUE_NORMAL_OPERATION", "LOW",
                "{m} operating within standard safety envelope. Proceed with current shift production schedule.")
AGENT_NAMES = ["Vision Agent", "Predictive Maintenance Agent", "Knowledge Agent"]
DEFAULT_TOP_SOURCE = "Default SOP"
DEFAULT_EVIDENCE_SOURCE = "Default SOP Standard"
DEFAULT_EVIDENCE_CONTENT = ("Standard Operating Protocol: Keep machine temperature below 80C and "
                            "vibration under 3.5 mm/s.")

# Explanation sentence pieces.
EXPLAIN_VIBRATION = "Vibration ({v} mm/s) is +{pct}% above normal baseline"
EXPLAIN_TEMPERATURE = "Operating temperature ({t}°C) exceeds warning threshold of 80°C"
EXPLAIN_PRESSURE = "Hydraulic pressure ({p} bar) is outside optimal 90-110 bar window"
EXPLAIN_NORMAL = ("Model Confidence: {c}% Normal. All sensor telemetry signals remain within "
                  "healthy operational limits.")
EXPLAIN_RISK = "Failure Risk Confidence: {c}%. Primary Drivers: {r}."

# The prompt for a language model and the text used without one. Placeholders in braces.
PROMPT = """You are an Autonomous AI Factory Intelligence System explaining a predictive maintenance alert to a plant supervisor.

PREDICTIVE MODEL OUTPUT:
{summary}

RETRIEVED FACTORY SOP & MANUAL EVIDENCE:
{evidence}

INSTRUCTIONS:
1. Explain what is happening in the factory now and why the ML model flagged a risk.
2. Ground your explanation directly in the retrieved SOP evidence and cite the exact source file and section.
3. Recommend specific maintenance and safety actions for the operator to take.
4. Keep the explanation concise, professional, and clear for high-stakes manufacturing operations."""
PROMPT_SUMMARY = """{
  "machine_id": "{machine}",
  "failure_probability": {probability},
  "vibration": {vibration},
  "temperature": {temperature}
}"""
GROUNDED_EXPLANATION = """**Current Factory Status:**
The predictive telemetry engine has detected an abnormal anomaly pattern on machine **{machine}**.
- **Failure Probability:** {percent}%
- **Key Sensor Indicators:** Vibration ({vibration} mm/s) and Temperature ({temperature}°C).

**Grounded RAG SOP Evidence ({source}):**
> "{content}"

**Recommended Action Plan:**
1. **Immediate Step:** {action}
2. **Maintenance Step:** Inspect spindle bearing lubrication and check thermal fuse condition per **{source}**.
3. **Safety Protocol:** Require safety goggles and thermal gloves before inspecting mechanical housing."""

# Surface verdict thresholds and labels.
HEAT_RATIO_LIMIT = 1.4
EDGE_DENSITY_LOW = 0.015
EDGE_DENSITY_HIGH = 0.035
GREY_RANGE_LOW = 100.0
GREY_RANGE_HIGH = 140.0
GREY_WEIGHTS = (0.299, 0.587, 0.114)
# Edge detector: low and high threshold, tan(22.5 degrees) * 2 ** 15. Region box: least corner, least side, distance of
# the default box from the centre, its side.
CANNY_LOW = 30
CANNY_HIGH = 120
CANNY_TAN_22 = 13573
REGION_BOX = (5, 20, 20, 40)
HEAT_KERNEL_SIGMA = 28.0

# Human decisions.
DECISION_TYPES = ["APPROVE", "REJECT", "MODIFY"]
DECISION_STATUS = "LOGGED_TO_CONTINUOUS_LEARNING_QUEUE"
DEFAULT_DECISION_NOTES = "Approved without modification."

# Retraining parameters: learning rate, and estimators = base + decisions * step.
RETRAIN_LEARNING_RATE = 0.05
RETRAIN_BASE_ESTIMATORS = 120
RETRAIN_ESTIMATORS_STEP = 5



# ---------------------------------------------------------------------------
# Tunable parameter sets (defaults equal the fixed values above)
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class DashboardRisk:
    base: float = 0.05
    temp_limit: float = 80.0
    temp_slope: float = 0.02
    vib_limit: float = 3.5
    vib_slope: float = 0.15
    press_low: float = 85.0
    press_high: float = 120.0
    press_add: float = 0.20
    floor: float = 0.02
    ceiling: float = 0.99
    critical: float = 0.65
    warning: float = 0.35
    alert_temp: float = 75.0


@dataclass(frozen=True)
class MachineRisk:
    base: float = 0.05
    temp_limit: float = 78.0
    temp_span: float = 25.0
    temp_weight: float = 0.45
    vib_limit: float = 3.2
    vib_span: float = 3.0
    vib_weight: float = 0.50
    press_add: float = 0.30
    hydraulic_low: float = 70.0
    hydraulic_high: float = 135.0
    other_high: float = 65.0
    floor: float = 0.04
    ceiling: float = 0.98
    critical: float = 0.60
    warning: float = 0.30


@dataclass(frozen=True)
class PlantCosts:
    hourly_rate: float = 120.0
    unit_revenue: float = 45.0
    maintenance_per_hour: float = 250.0
    failure_cost: float = 15000.0
    shift_hours: float = 8.0


@dataclass(frozen=True)
class SplitRatios:
    train: float = 0.7
    val: float = 0.15


@dataclass(frozen=True)
class CleaningParams:
    sensors: tuple = tuple(SENSOR_COLUMNS)
    capped: tuple = tuple(CAPPED_COLUMNS)
    iqr_factor: float = IQR_FACTOR
    windows: tuple = tuple(ROLLING_WINDOWS)


@dataclass(frozen=True)
class SkewParams:
    """Hot-key handling for per-machine row windows.

    A machine with more than ``hot_rows`` readings is processed in position
    chunks of ``chunk_rows`` rows plus the overlap its frames need, so no task
    ever holds more than ``max(hot_rows, chunk_rows + overlap)`` rows of one key.
    """
    hot_rows: int = 2_000_000
    chunk_rows: int = 1_000_000


@dataclass(frozen=True)
class RetrievalParams:
    top_k: int = 2
    min_chunk_chars: int = 20
    delimiter: str = "\n"
    token_pattern: str = r"(?U)\b\w\w+\b"
    stop_words: bool = True
    extra: dict = field(default_factory=dict)


# ---------------------------------------------------------------------------
# What-if scenarios (id, name, description)
# ---------------------------------------------------------------------------

SCENARIOS = [
    ("SCENARIO_1", "Continue Operation (Status Quo)",
     "Keep machine running at full speed without intervention."),
    ("SCENARIO_2", "Immediate Maintenance Shutdown",
     "Halt machine for 2.5h planned repair, then resume at full capacity."),
    ("SCENARIO_3", "Reduce Load (-30% Speed)",
     "Operate at 70% capacity to lower stress and delay breakdown until scheduled shift end."),
    ("SCENARIO_4", "Reroute to Backup Line",
     "Transfer batch to secondary production line (Line 02) with 1h setup."),
]
SHUTDOWN_HOURS = 2.5
SHUTDOWN_RESIDUAL_RISK = 0.05
REDUCED_RATE_FACTOR = 0.70
REDUCED_RISK_FACTOR = 0.40
CONTINUE_DOWNTIME_FACTOR = 0.7
CONTINUE_CRITICAL_ABOVE = 0.7
REROUTE_SETUP_HOURS = 1.0
REROUTE_RATE_FACTOR = 0.85
REROUTE_RESIDUAL_RISK = 0.02
REROUTE_SETUP_COST = 300.0

# Spark MLlib's default English stop words (public list, alphabetical).
ENGLISH_STOP_WORDS = tuple("""
a about above after again against all am an and any are aren't as at be because been before being
below between both but by can can't cannot could couldn't did didn't do does doesn't doing don don't
down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's
her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it
it's its itself just let's me more most mustn't my myself no nor not now of off on once only or
other ought our ours ourselves out over own s same shan't she she'd she'll she's should shouldn't so
some such t than that that's the their theirs them themselves then there there's these they they'd
they'll they're they've this those through to too under until up very was wasn't we we'd we'll we're
we've were weren't what what's when when's where where's which while who who's whom why why's will
with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
""".split())
