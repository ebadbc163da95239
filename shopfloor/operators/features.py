"""Telemetry cleaning + feature engineering, and the time-ordered split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from shopfloor.functions import constants as K
from shopfloor.functions.constants import CleaningParams, SkewParams, SplitRatios
from shopfloor.operators.cleaning import impute_and_cap
from shopfloor.operators.positions import row_positions
from shopfloor.operators.rolling import Builder, keyed_windows

KEY = ["machine_id"]


def rolling_columns(windows: Sequence[int]) -> Builder:
    """Row-count frames of k rows ending at the current row (pandas min_periods=1)."""

    def build(w: WindowSpec) -> list[Column]:
        cols = []
        for k in windows:
            f = w.rowsBetween(-(k - 1), Window.currentRow)
            cols += [
                F.avg("temperature").over(f).alias(f"temp_roll_mean_{k}h"),
                F.coalesce(F.stddev_samp("temperature").over(f), F.lit(0.0)).alias(f"temp_roll_std_{k}h"),
                F.avg("vibration").over(f).alias(f"vib_roll_mean_{k}h"),
                F.max("vibration").over(f).alias(f"vib_roll_max_{k}h"),
                F.avg("pressure").over(f).alias(f"press_roll_mean_{k}h"),
            ]
        return cols

    return build


INTERACTIONS = ["vib_temp_interaction", "vib_press_ratio", "rpm_vib_ratio"]


def interaction_columns() -> dict[str, Column]:
    v, t, p, r = F.col("vibration"), F.col("temperature"), F.col("pressure"), F.col("rpm")
    return {
        "vib_temp_interaction": v * t,
        "vib_press_ratio": F.try_divide(v, p + 1e-5),
        "rpm_vib_ratio": F.try_divide(r, v + 1e-5),
    }


def feature_names(windows: Sequence[int] = K.ROLLING_WINDOWS) -> list[str]:
    names = list(K.SENSOR_COLUMNS)
    for k in windows:
        names += [f"temp_roll_mean_{k}h", f"temp_roll_std_{k}h", f"vib_roll_mean_{k}h",
                  f"vib_roll_max_{k}h", f"press_roll_mean_{k}h"]
    names += INTERACTIONS + ["temp_lag_1", "vib_lag_1"]
    return names


def engineer_features(raw: DataFrame, order: Sequence[str], params: CleaningParams = CleaningParams(),
                      skew: SkewParams = SkewParams(), stats: dict | None = None) -> DataFrame:
    """Impute (global medians) -> cap (IQR of imputed values) -> per-machine rolling
    frames -> interactions -> forward/back fills. Rows without a machine drop
    (they have no group), after the global statistics are taken. ``stats``: statistics fitted before, where ``raw``
    holds some machines only."""
    cleaned = impute_and_cap(raw, params, stats=stats).where(F.col("machine_id").isNotNull())
    lookback = max(params.windows) - 1
    feats = keyed_windows(cleaned, KEY, order, rolling_columns(params.windows), lookback,
                          fills=[("temp_lag_1", "temperature"), ("vib_lag_1", "vibration")], skew=skew)
    feats = feats.withColumns(interaction_columns())
    rolled = [n for n in feature_names(params.windows) if n not in K.SENSOR_COLUMNS]
    base = [c for c in raw.columns if c not in rolled]
    return feats.select(*base, *rolled)


def true_lag(df: DataFrame, order: Sequence[str], cols: Sequence[str], skew: SkewParams = SkewParams()) -> DataFrame:
    """The previous reading of the same machine (NULL on a machine's first row)."""

    def build(w):
        return [F.lag(c, 1).over(w).alias(f"{c}_prev") for c in cols]

    return keyed_windows(df, KEY, order, build, 1, skew=skew)


def fill_forward_back(df: DataFrame, order: Sequence[str], cols: Sequence[str],
                      skew: SkewParams = SkewParams()) -> DataFrame:
    return keyed_windows(df, KEY, order, lambda w: [], 0,
                         fills=[(f"{c}_filled", c) for c in cols], skew=skew)


def sequences(df: DataFrame, order: Sequence[str], features: Sequence[str], label: str,
              length: int = 12, skew: SkewParams = SkewParams(), keep: Sequence[str] = ()) -> DataFrame:
    """Per machine: the ``length`` preceding feature rows and this row's label (and the
    columns ``keep``). A machine's first ``length`` rows have no full history and drop."""

    def build(w):
        f = w.rowsBetween(-length, -1)
        return [F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(f)
                .alias("sequence")]

    out = keyed_windows(df.select(*KEY, *order, *features, label, *keep), KEY, order, build, length, skew=skew)
    return out.where(F.size("sequence") == length)


def split_positions(keys: DataFrame, order: Sequence[str], ratios: SplitRatios = SplitRatios()) -> tuple[DataFrame, dict]:
    """(order columns + row_index, {"train": end, "val": end}): positions in global order from
    range-partitioned counts; only the key columns are moved."""
    pos = row_positions(keys.select(*order), order, (), "row_index")
    n = pos.count()  # reads the materialised positions, not the upstream plan
    return pos, {"train": int(n * float(ratios.train)), "val": int(n * float(ratios.train + ratios.val))}


def split_name(index: str | Column, ends: dict) -> Column:
    i = F.col(index) if isinstance(index, str) else index
    return F.when(i < ends["train"], F.lit("train")).when(i < ends["val"], F.lit("val")).otherwise(F.lit("test"))


def with_split(df: DataFrame, order: Sequence[str], ratios: SplitRatios = SplitRatios(),
               keys: DataFrame | None = None) -> DataFrame:
    """Positional train/val/test by global order: first int(n*train) rows train, up to
    int(n*(train+val)) val, rest test. ``order`` must be unique. The two border keys are found
    on ``keys`` (default: the key columns of ``df``); the rows themselves only compare with them."""
    pos, ends = split_positions(df if keys is None else keys, order, ratios)
    kinds = {f.name: f.dataType for f in pos.schema.fields}
    borders = {r["row_index"]: F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in order])
               for r in pos.where(F.col("row_index").isin(*ends.values())).collect()}  # at most two rows
    own, out = F.struct(*order), F.lit("test")
    for name in ("val", "train"):
        border = borders.get(ends[name])
        out = F.lit(name) if border is None else F.when(own < border, F.lit(name)).otherwise(out)
    return df.withColumn("split", out)
