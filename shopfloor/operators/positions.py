"""Order positions and running totals without a single-partition window.

A plain ``row_number().over(Window.orderBy(...))`` moves every row into one
task. Here the rows are range-partitioned on the full order key (Spark samples
the key, so one hot value of the leading column is still split on the later
ones), each partition is sorted locally, and only a tiny table of per-partition
counts crosses partitions: ``#partitions x #groups-in-partition`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _materialize(df: DataFrame) -> DataFrame:
    """Fix partition ids and in-partition order once: both the small count table and
    the row branch must see the same physical partitions, and a recomputed upstream
    shuffle may be coalesced differently by AQE. Reliable checkpoint into the
    cluster's shared ``spark.checkpoint.dir`` (never a local checkpoint)."""
    from shopfloor.session import shared_dir

    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _ranged(df: DataFrame, num_partitions: int | None, keys: list[Column]) -> DataFrame:
    """Range-partitioned rows; without a fixed number, adaptive execution merges small ranges
    (neighbours, so partition numbers keep the order)."""
    return df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)


def _join_spans(rows: DataFrame, spans: DataFrame, group: Sequence[str]) -> DataFrame:
    """Join on the partition number and the group, NULL groups included."""
    same = rows["_pid"] == spans["_pid"]
    for g in group:
        same = same & rows[g].eqNullSafe(spans[g])
    return rows.join(spans, same).drop(spans["_pid"], *[spans[g] for g in group])


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def row_positions(df: DataFrame, order: Sequence[str | Column], group: Sequence[str] = (),
                  pos_col: str = "pos", num_partitions: int | None = None) -> DataFrame:
    """Add ``pos_col``: 0-based position of the row in ``order`` within ``group``.

    ``order`` (with ``group``) must be unique, otherwise positions of tied rows
    are arbitrary (as with any row_number).
    """
    keys = list(group) + list(order)
    ranged = _materialize(_ranged(df, num_partitions, _cols(keys))
                          .sortWithinPartitions(*_cols(keys))
                          .withColumn("_pid", F.spark_partition_id())
                          .withColumn("_rid", F.monotonically_increasing_id()))
    # A group's rows are contiguous inside a partition: first id + count describe them.
    spans = ranged.groupBy("_pid", *group).agg(F.min("_rid").alias("_first"),
                                              F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_pid", *group, "_first",
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    out = _join_spans(ranged, spans, group)
    return out.withColumn(pos_col, F.col("_offset") + F.col("_rid") - F.col("_first")) \
        .drop("_pid", "_rid", "_first", "_offset")


def running_totals(df: DataFrame, order: Sequence[str], weights: Sequence[str], group: Sequence[str] = (),
                   suffix: str = "_before", num_partitions: int | None = None) -> DataFrame:
    """Add ``<w><suffix>`` = sum of ``w`` over the rows strictly before this one in
    ``order`` within ``group``, and ``<w>_total`` = the group's sum of ``w``."""
    keys = list(group) + list(order)
    ranged = _materialize(_ranged(df, num_partitions, _cols(keys)).withColumn("_pid", F.spark_partition_id()))
    sums = ranged.groupBy("_pid", *group).agg(*[F.sum(w).alias(f"_s_{w}") for w in weights])
    w_before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*group)
    offs = sums.select("_pid", *group,
                       *[F.coalesce(F.sum(f"_s_{w}").over(w_before), F.lit(0)).alias(f"_o_{w}")
                         for w in weights],
                       *[F.sum(f"_s_{w}").over(w_all).alias(f"{w}_total") for w in weights])
    local_w = Window.partitionBy("_pid", *group).orderBy(*_cols(order)) \
        .rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(w).over(local_w), F.lit(0)).alias(f"_l_{w}")
                                 for w in weights])
    out = _join_spans(local, offs, group)
    return out.select(*df.columns,
                      *[(F.col(f"_o_{w}") + F.col(f"_l_{w}")).alias(f"{w}{suffix}") for w in weights],
                      *[F.col(f"{w}_total") for w in weights])
