"""As-of join: every row takes the parameters that were valid for its key at its time.

Parameter rows and data rows of a key are put in one time order and the last parameter row is carried forward: one
exchange by key and one sort, whatever the number of intervals, instead of comparing every row with every interval
of its key. Keys with more rows than one task should hold are cut into position chunks, and the parameters in force at
a chunk's start reach it through a small per-chunk summary (``rolling.keyed_windows``).

Defined results: a row before the first interval, in a gap (at or after ``valid_to``), of a key without parameters or
without a time takes the defaults, and so does a single parameter that is null. Of intervals with the same start the one
with the largest values counts. A NULL key is a key like any other.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.functions.constants import SkewParams
from shopfloor.operators.rolling import keyed_windows


def as_of_join(rows: DataFrame, params: DataFrame, key: str, ts: str, defaults: Mapping[str, float],
               valid_from: str = "valid_from", valid_to: str = "valid_to", skew: SkewParams = SkewParams()) -> DataFrame:
    """``rows`` plus one column per name in ``defaults``. params: key, valid_from, valid_to (null: open) and those names."""
    known = F.struct(F.col(valid_from).cast("timestamp").alias("since"), F.col(valid_to).cast("timestamp").alias("until"), *defaults)
    starts = params.groupBy(F.col(key), F.col(valid_from).cast("timestamp").alias("_at")).agg(F.max(known).alias("_known")) \
        .withColumn("_is_row", F.lit(1))
    data = rows.withColumn("_at", F.col(ts).cast("timestamp")).withColumn("_is_row", F.lit(2))
    both = starts.unionByName(data, allowMissingColumns=True)
    filled = keyed_windows(both, [key], ["_at", "_is_row"], lambda w: [], 0, [("_valid", "_known")], skew).where("_is_row = 2")
    inside = (F.col("_valid.since") <= F.col("_at")) & (F.col("_valid.until").isNull() | (F.col("_at") < F.col("_valid.until")))
    return filled.select(*rows.columns, *[F.coalesce(F.when(inside, F.col(f"_valid.{c}")), F.lit(v)).alias(c) for c, v in defaults.items()])
