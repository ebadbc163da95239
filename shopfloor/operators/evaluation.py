"""Binary classification metrics as aggregates (one pass, partial aggregation).

Inputs carry ``y`` (0/1 label), ``pred`` (0/1) and ``score`` (probability of 1).
``group`` columns (e.g. model, split) evaluate many slices in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.operators.positions import running_totals


def confusion(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp (true counts also when only one class occurs)."""
    y, p = F.col("y"), F.col("pred")

    def n(cond):
        return F.count(F.when(cond, F.lit(1))).alias

    aggs = [n((y == 0) & (p == 0))("tn"), n((y == 0) & (p == 1))("fp"),
            n((y == 1) & (p == 0))("fn"), n((y == 1) & (p == 1))("tp")]
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


def prf1(conf: DataFrame, group: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Precision, recall, F1 of class 1; 0 when undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def ratio(num, den):
        return F.round(F.coalesce(F.try_divide(num.cast("double"), F.nullif(den, F.lit(0)).cast("double")),
                                  F.lit(0.0)), digits)

    return conf.select(*group, ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                       ratio(tp * 2, tp * 2 + fp + fn).alias("f1"))


def error_text(conf: DataFrame) -> DataFrame:
    return conf.select(F.format_string(
        "Error Analysis: %d missed failures (False Negatives - critical risk) and %d false alarms "
        "(False Positives).", F.col("fn"), F.col("fp")).alias("explanation"))


def roc_auc(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Rank-based ROC-AUC with ties counted half:
    sum over distinct scores of pos * (negatives below + neg/2) / (P * N).
    Scores collapse to distinct values first (partial aggregate), then running totals
    over the score order come from range-partitioned sums, never one task."""
    g = df.groupBy(*group, "score").agg(F.sum("y").cast("long").alias("pos"),
                                        F.sum(F.lit(1) - F.col("y")).cast("long").alias("neg"))
    rt = running_totals(g, ["score"], ["neg", "pos"], group)
    contrib = F.col("pos") * (F.col("neg_before") + F.col("neg") * 0.5)
    aggs = [(F.sum(contrib) / (F.first("pos_total") * F.first("neg_total"))).alias("roc_auc")]
    return rt.groupBy(*group).agg(*aggs) if group else rt.agg(*aggs)
