"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition is a *run*: its documents reduced to (digest, best id, count). Runs
are exchanged in binomial rounds: in round r all runs whose numbers agree above bit
``r * fan_in_bits`` meet, are merged by digest, and only the winning identifier and the
count go on. A digest that fills a third of the table therefore shrinks to one row per run
before the first exchange and to one row per merged run after each round; the rows of a
round are spread over all tasks by (run, digest), so no task holds a whole run. What stands for the parts of
the method in Spark: a run is the rows with one run number, wherever they lie; the exchange of a round is the
shuffle by (run, digest); sorted order and multiway merge are Spark's sort-based aggregate, which sorts each
task's rows by (run, digest) and folds equal digests of all runs that meet in one pass, keeping the verified best id.

A digest match is verified by two further values that travel with it (the byte length and
an independent 64-bit hash): rows only merge when SHA-256, length and hash all agree.

Defined results: null text is the empty text. Rows that repeat a document id are rows of
their own; of equal rows with the same id exactly one is kept. A null id ranks below every
id. An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.session import materialize


def digest_runs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, run, digest, bytes, check): one narrow row per document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), text.alias("t")).select(
        "id", F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run"),
        F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").alias("bytes"),
        F.xxhash64("t").alias("check"))


def tree_merge(runs: DataFrame, fan_in_bits: int = 4, rounds: int = 3) -> DataFrame:
    """(digest, bytes, check, best struct<id, row>, n) after the last round. Run numbers
    are taken modulo ``2 ** (fan_in_bits * rounds)``, so the last round leaves one run."""
    key = ["digest", "bytes", "check"]
    level = runs.withColumn("run", F.col("run") % (1 << (fan_in_bits * rounds))) \
        .select("run", *key, F.struct("id", "row").alias("best"), F.lit(1).cast("long").alias("n"))
    for _ in range(rounds):
        level = level.withColumn("run", F.shiftright("run", fan_in_bits)).groupBy("run", *key) \
            .agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    return level.drop("run")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                fan_in_bits: int = 4, rounds: int = 3) -> DataFrame:
    """One row per input row: ``id_col``, keep_id (largest id of the equal texts),
    group_size, kept, text_sha256 (lowercase hex)."""
    members = materialize(digest_runs(df, id_col, text_col), "digest-runs")
    merged = tree_merge(members, fan_in_bits, rounds)
    return members.join(merged, ["digest", "bytes", "check"]).select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
