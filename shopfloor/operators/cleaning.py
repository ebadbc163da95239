"""Global column statistics, median imputation and IQR capping.

Statistics are exact, distributed and the same at every size (see ``fit_stats``). The
result is fetched once (~20 numbers, like an MLlib ``fit``) and applied as literals, so the
row plan stays a plain projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.functions.constants import CleaningParams
from shopfloor.operators.quantiles import sketch_columns, values_at

QUARTILES = (0.25, 0.75)


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: ``nulls_<c>`` for every column, in one pass."""
    return df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"nulls_{c}") for c in cols])


def fit_stats(df: DataFrame, params: CleaningParams = CleaningParams()) -> dict:
    """Null counts and medians of every sensor, quartiles and caps of the capped sensors after
    imputation: ``nulls_c``, ``med_c``, ``q1_c``, ``q3_c``, ``lo_c``, ``hi_c``.

    Quantiles interpolate: with n values, q(p) = v[lo] + (v[hi] - v[lo]) * (pos - lo) at pos = (n - 1) p. The
    imputed column is the column with ``nulls`` more copies of its median: a rank there is a rank of the
    column, the median, or a rank ``nulls`` lower. So all that is needed are a few exact ranks of each
    column, found in two scans (``quantiles.values_at``)."""
    sensors, capped = list(params.sensors), list(params.capped)
    sketches = sketch_columns(df, list(dict.fromkeys([*sensors, *capped])))

    def around(n: int, p: float) -> tuple[int, int, float]:
        pos = (n - 1) * p
        return math.floor(pos), math.ceil(pos), pos - math.floor(pos)

    wanted = {}
    for c, s in sketches.items():
        ranks = {*around(s.n, 0.5)[:2]} if s.n else set()
        if s.n and c in capped:
            for p in QUARTILES:
                ranks |= {r - shift for r in around(s.n + s.nulls, p)[:2] for shift in (0, s.nulls) if 0 <= r - shift < s.n}
        wanted[c] = ranks
    at = values_at(df, sketches, wanted)

    stats: dict = {}
    for c, s in sketches.items():
        stats[f"nulls_{c}"], stats[f"med_{c}"] = s.nulls, None
        if s.n:
            lo, hi, part = around(s.n, 0.5)
            low, high = at[c, lo], at[c, hi]
            stats[f"med_{c}"] = low.value + (high.value - low.value) * part
    for c in capped:
        s, med = sketches[c], stats[f"med_{c}"]
        stats |= {f"{k}_{c}": None for k in ("q1", "q3", "lo", "hi")}
        if not s.n:
            continue
        low = at[c, around(s.n, 0.5)[0]]
        first, last = (low.before, low.before + low.count) if low.value == med else (low.before + low.count,) * 2

        def filled(r: int) -> float:
            """The value at rank r of the imputed column: ``nulls`` more copies of the median from ``first`` on."""
            if r < first:
                return at[c, r].value
            return med if r < last + s.nulls else at[c, r - s.nulls].value

        q1, q3 = (filled(lo) + (filled(hi) - filled(lo)) * part for lo, hi, part in (around(s.n + s.nulls, p) for p in QUARTILES))
        stats |= {f"q1_{c}": q1, f"q3_{c}": q3, f"lo_{c}": q1 - (q3 - q1) * params.iqr_factor,
                  f"hi_{c}": q3 + (q3 - q1) * params.iqr_factor}
    return stats


def stats_frame(spark, stats: dict, cols: Sequence[str]) -> DataFrame:
    """The fitted statistics as a one-row DataFrame (for reporting)."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in cols])
    return spark.createDataFrame([tuple(None if stats.get(c) is None else float(stats[c]) for c in cols)], schema)


def impute_median(df: DataFrame, stats: dict, cols: Sequence[str]) -> DataFrame:
    out = {}
    for c in cols:
        med = stats.get(f"med_{c}")
        if stats.get(f"nulls_{c}", 0) and med is not None:
            out[c] = F.coalesce(F.col(c), F.lit(float(med)))
    return df.withColumns(out) if out else df


def _bound(stats: dict, name: str) -> Column:
    v = stats.get(name)
    return F.lit(None).cast("double") if v is None else F.lit(float(v))


def clip_iqr(df: DataFrame, stats: dict, cols: Sequence[str]) -> DataFrame:
    """Clamp into [lo, hi]; NULL stays NULL (Spark's least/greatest skip nulls)."""
    out = {}
    for c in cols:
        lo, hi = _bound(stats, f"lo_{c}"), _bound(stats, f"hi_{c}")
        out[c] = F.when(F.col(c).isNull(), F.lit(None).cast("double")).otherwise(
            F.greatest(lo, F.least(hi, F.col(c))))
    return df.withColumns(out)


def outlier_flags(df: DataFrame, stats: dict, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_outlier": ~F.col(c).between(_bound(stats, f"lo_{c}"),
                                                            _bound(stats, f"hi_{c}"))
                           for c in cols})


def impute_and_cap(df: DataFrame, params: CleaningParams = CleaningParams(),
                   with_flags: bool = False, stats: dict | None = None) -> DataFrame:
    """Median fill of every sensor that has gaps, then IQR capping of the capped sensors."""
    s = stats if stats is not None else fit_stats(df, params)
    out = impute_median(df, s, params.sensors)
    if with_flags:
        out = outlier_flags(out, s, params.capped)
    return clip_iqr(out, s, params.capped)
