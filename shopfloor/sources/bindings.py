"""Bindings: the reference's tables expressed over the driver's parquet tables.

Every binding is a pure projection (no shuffle), so Catalyst prunes columns
and pushes filters through it into the parquet scan. The SQL text of the same
bindings lives in ``shopfloor.plans.oracle`` for the DuckDB check.

telemetry   lineitem -> one reading per line item; machine from the supplier
production  lineitem -> one batch per line item
incidents   events   -> maintenance log text (six templates by event id)
readings    events   -> one sensor payload per event (the stream input)
decisions   events   -> supervisor decisions (purchase/error/signup events)
chunks      documents-> manual sections (split on the line delimiter)
queries     benchmark-> retrieval questions
pixels      embeddings -> 8x8 RGB tiles, one row per pixel
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.functions import constants as K
from shopfloor.functions import rules as R

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def machine_name(kind_key: Column, serial: Column) -> Column:
    """'<kind name> #<serial>' where the kind is picked by ``kind_key % 4``."""
    kinds = F.array(*[F.lit(m) for m in K.MACHINE_NAMES])
    return F.concat(F.element_at(kinds, (kind_key % 4).cast("int") + 1), F.lit(" #"),
                    serial.cast("string"))


def telemetry(spark: SparkSession, sf_dir: str, machine_id: str | None = None) -> DataFrame:
    """Sensor readings with injected sensor errors (999.0) and missing vibration.

    ``is_failure`` follows the threshold rule on the true (pre-error) values.
    ``(machine_id, ts, k1, k2, k3)`` is unique. With ``machine_id`` only that machine's readings, by its serial
    number in the scan.
    """
    li = table(spark, sf_dir, "lineitem")
    if machine_id is not None:
        li = li.where(F.col("l_suppkey") == int(machine_id.rsplit("#", 1)[1])) \
            .where(machine_name(F.col("l_suppkey"), F.col("l_suppkey")) == machine_id)
    true_temp = F.lit(50.0) + F.col("l_quantity")
    true_vib = F.lit(1.0) + F.col("l_discount") * 50
    label = ((true_temp > K.FAILURE_TEMPERATURE) | (true_vib > K.FAILURE_VIBRATION)).cast("int")
    return li.select(
        F.col("l_shipdate").alias("ts"),
        machine_name(F.col("l_suppkey"), F.col("l_suppkey")).alias("machine_id"),
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"),
        F.col("l_partkey").alias("k3"),
        F.when(F.col("l_orderkey") % 499 == 0, F.lit(999.0)).otherwise(true_temp).alias("temperature"),
        F.when(F.col("l_partkey") % 101 == 0, F.lit(None).cast("double")).otherwise(true_vib)
        .alias("vibration"),
        (F.lit(40.0) + F.col("l_tax") * 1250).alias("pressure"),
        (F.lit(1000.0) + F.col("l_extendedprice") / 30).alias("rpm"),
        (F.lit(212.0) + (F.col("l_partkey") % 17).cast("double")).alias("voltage"),
        label.alias("is_failure"),
        R.failure_type(label).alias("failure_type"),
    )


TELEMETRY_ORDER = ["ts", "k1", "k2", "k3"]


def production(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    units = (F.lit(80) + F.col("l_quantity").cast("int"))
    defects = F.floor(F.col("l_quantity") * F.col("l_discount")).cast("int")
    kind = F.col("l_partkey") % 10
    dtype = (F.when(defects == 0, F.lit(None).cast("string"))
             .when(kind < 4, F.lit("Crack")).when(kind < 7, F.lit("Scratch"))
             .when(kind < 9, F.lit("Overheat")).otherwise(F.lit("Misalignment")))
    return li.select(
        F.concat(F.lit("BAT-"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("batch_id"),
        F.concat(F.lit("LINE-0"), (F.col("l_suppkey") % 3 + 1).cast("string")).alias("line_id"),
        machine_name(F.col("l_suppkey"), F.col("l_suppkey")).alias("machine_id"),
        F.col("l_shipdate").alias("ts"),
        units.alias("units_produced"), defects.alias("defect_count"),
        R.quality_score(defects, units).alias("quality_score"),
        dtype.alias("defect_type"),
    )


def _templates_expr(i: int) -> Column:
    return F.array(*[F.lit(t[i]) for t in K.INCIDENT_TEMPLATES])


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    slot = (F.col("event_id") % 6).cast("int") + 1
    return ev.select(
        F.col("event_id"),
        F.concat(F.lit("LOG-"), F.col("event_id").cast("string")).alias("log_id"),
        F.col("ts"),
        machine_name(F.col("user_id"), F.col("user_id")).alias("machine_id"),
        F.element_at(_templates_expr(0), slot).alias("incident_text"),
        F.element_at(_templates_expr(1), slot).alias("labelled_urgency"),
        F.element_at(_templates_expr(2), slot).alias("action_taken"),
        (F.lit(0.5) + (F.col("event_id") % 76).cast("double") / 10).alias("downtime_hours"),
    )


def readings(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """One sensor payload per event; ``events`` may be a streaming DataFrame."""
    ev = events if events is not None else table(spark, sf_dir, "events")
    k = F.get_json_object(F.col("props"), "$.k").cast("double")
    return ev.select(
        F.col("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        machine_name(F.col("user_id"), F.col("user_id")).alias("machine_id"),
        (F.lit(50.0) + F.col("value") / 10).alias("temperature"),
        (F.lit(1.0) + k / 20).alias("vibration"),
        (F.lit(60.0) + (F.col("event_id") % 90).cast("double")).alias("pressure"),
        F.col("event_type"),
        F.col("user_id").alias("image_id"),
    )


def cost_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost parameters of the machines that suppliers keep, with the time they hold: rates from the start of 2024,
    other ones from the 15th on, which end on the 25th for every fifth supplier."""
    s = table(spark, sf_dir, "supplier")
    first = F.struct(F.lit("2024-01-01").alias("a"), F.lit("2024-01-15").alias("b"), (F.lit(100.0) + F.col("s_suppkey") % 50).alias("rate"),
                     (F.lit(40.0) + F.col("s_nationkey")).alias("revenue"), F.lit(None).cast("double").alias("failure"))
    then = F.struct(F.lit("2024-01-15").alias("a"), F.when(F.col("s_suppkey") % 5 == 0, "2024-01-25").alias("b"),
                    (F.lit(80.0) + F.col("s_suppkey") % 90).alias("rate"), F.lit(45.0).alias("revenue"),
                    (F.lit(9000.0) + F.col("s_suppkey") * 10).alias("failure"))
    return s.select(machine_name(F.col("s_suppkey"), F.col("s_suppkey")).alias("machine_id"), F.explode(F.array(first, then)).alias("p")) \
        .select("machine_id", F.col("p.a").cast("timestamp").alias("valid_from"), F.col("p.b").cast("timestamp").alias("valid_to"),
                F.col("p.rate").alias("hourly_rate"), F.col("p.revenue").alias("unit_revenue"), F.col("p.failure").alias("failure_cost"))


def decisions(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Supervisor decisions: purchase -> APPROVE, error -> REJECT, signup -> MODIFY,
    view -> ESCALATE (not a valid decision type). A decision reviews the reading event
    ``target_event_id`` (the first event of its block of ten)."""
    ev = events if events is not None else table(spark, sf_dir, "events")
    dtype = (F.when(F.col("event_type") == "purchase", F.lit("APPROVE"))
             .when(F.col("event_type") == "error", F.lit("REJECT"))
             .when(F.col("event_type") == "signup", F.lit("MODIFY"))
             .when(F.col("event_type") == "view", F.lit("ESCALATE")))
    k = F.get_json_object(F.col("props"), "$.k")
    notes = (F.when(F.col("event_type") == "signup", F.concat(F.lit("Reduce load by "), k, F.lit("%")))
             .when(F.col("event_type") == "error", F.lit("")))
    return ev.where(dtype.isNotNull()).select(
        F.col("event_id"),
        F.col("ts"),
        (F.col("event_id") - F.col("event_id") % 10).alias("target_event_id"),
        F.concat(F.lit("SUP-"), F.col("user_id").cast("string")).alias("supervisor_id"),
        dtype.alias("decision_type"),
        notes.alias("notes_in"),
    )


def chunks(spark: SparkSession, sf_dir: str, delimiter: str = "\n", min_chars: int = 20) -> DataFrame:
    """Manual sections: split, strip surrounding whitespace, keep longer than ``min_chars``;
    sections are numbered after the short ones drop."""
    docs = table(spark, sf_dir, "documents")
    return section_rows(docs.select("doc_id", "source", "text"), delimiter, min_chars)


# Characters stripped from both ends of a section (Java's \s set).
WHITESPACE = " \t\n\x0b\x0c\r"


def section_rows(docs: DataFrame, delimiter: str, min_chars: int) -> DataFrame:
    import re
    parts = F.split(F.col("text"), re.escape(delimiter) if delimiter != "\n" else "\n")
    stripped = F.transform(parts, lambda x: F.btrim(x, F.lit(WHITESPACE)))
    kept = F.filter(stripped, lambda x: F.length(x) > min_chars)
    out = docs.select("doc_id", "source", F.posexplode(kept).alias("pos", "content"))
    src = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return out.select(
        "doc_id",
        (F.col("pos") + 1).alias("section_no"),
        F.format_string("%s (Section %d)", src, F.col("pos") + 1).alias("source"),
        "content",
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"),
                                                     F.col("text").alias("query"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 RGB tiles: pixel pos -> x = pos % 8, y = pos div 8; r, g, b are the elements at
    pos, pos+21, pos+42 (mod 64) scaled by floor((e + 0.5) * 256) into 0..255."""
    emb = table(spark, sf_dir, "embeddings")

    def chan(shift):
        e = F.element_at(F.col("embedding"), ((F.col("pos") + shift) % 64).cast("int") + 1)
        return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.5) * 256)
                                              .cast("int")))

    exploded = emb.select(F.col("vec_id").alias("image_id"), F.col("label"), "embedding",
                          F.posexplode(F.sequence(F.lit(0), F.lit(63))).alias("i", "pos"))
    return exploded.select(
        "image_id", "label",
        (F.col("pos") % 8).cast("int").alias("x"), (F.col("pos") / 8).cast("int").alias("y"),
        chan(0).alias("r"), chan(21).alias("g"), chan(42).alias("b"),
    )
