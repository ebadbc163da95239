"""Registered queries over the telemetry binding: statistics, cleaning, rolling
windows, fills, split, histogram and the flagship latest-risk query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopfloor.functions import constants as K
from shopfloor.functions import rules as R
from shopfloor.functions.constants import SplitRatios
from shopfloor.operators import cleaning, features
from shopfloor.plans import sqltext as S
from shopfloor.plans.registry import register, round_doubles, rsel
from shopfloor.sources import bindings as B

ORDER = B.TELEMETRY_ORDER
_RATIOS = SplitRatios()
_TRAIN_END = float(_RATIOS.train)
_VAL_END = float(_RATIOS.train + _RATIOS.val)
KEYS = ["ts", "machine_id", "k1", "k2", "k3"]


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.engineer_features(B.telemetry(spark, sf_dir), ORDER)


def keyed_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings that become feature rows (a machine is known), before any statistics."""
    return B.telemetry(spark, sf_dir).where(F.col("machine_id").isNotNull())


def latest_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current risk of every machine from cleaned data: the last reading of each
    machine (max_by over the order key: a partial aggregate, no full sort)."""
    f = featured(spark, sf_dir)
    keep = ["temperature", "vibration", "pressure", "temp_roll_mean_6h", "vib_roll_max_24h"]
    last = f.groupBy("machine_id").agg(F.max_by(F.struct("ts", *keep), F.struct(*ORDER)).alias("r"))
    last = last.select("machine_id", "r.*")
    prob = R.machine_risk("temperature", "vibration", "pressure", "machine_id")
    out = last.withColumn("failure_probability", prob) \
        .withColumn("health_status", R.machine_health("failure_probability"))
    return round_doubles(out)


_LATEST_COLS = ["machine_id", "ts", "temperature", "vibration", "pressure", "temp_roll_mean_6h",
                "vib_roll_max_24h", "failure_probability", "health_status"]
_LATEST_SQL = S.with_ctes(S.FEATURES, f"""last AS (
  SELECT * FROM features
  QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, k1 DESC, k2 DESC, k3 DESC) = 1)
SELECT {rsel(_LATEST_COLS, _LATEST_COLS[2:-1])} FROM (
  SELECT *, {S.machine_risk_sql()} AS failure_probability,
         {S.machine_health_sql(S.machine_risk_sql())} AS health_status FROM last)""")

register("w_latest_reading", _LATEST_SQL)(latest_risk)


@register("a_null_counts", S.with_ctes(S.TELEMETRY, "x AS (SELECT 1) SELECT " + ", ".join(
    f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls_{c}"
    for c in K.SENSOR_COLUMNS) + " FROM telemetry"))
def q_null_counts(spark, sf_dir):
    return cleaning.null_counts(B.telemetry(spark, sf_dir), K.SENSOR_COLUMNS)


@register("a_median", S.with_ctes(S.TELEMETRY, "x AS (SELECT 1) SELECT " + ", ".join(
    f"round(median({c}), 6) AS med_{c}" for c in K.SENSOR_COLUMNS) + " FROM telemetry"))
def q_median(spark, sf_dir):
    st = cleaning.fit_stats(B.telemetry(spark, sf_dir))
    return round_doubles(cleaning.stats_frame(spark, st, [f"med_{c}" for c in K.SENSOR_COLUMNS]))


_QCOLS = [f"{p}_{c}" for c in K.CAPPED_COLUMNS for p in ("q1", "q3", "lo", "hi")]


@register("a_quartiles", S.with_ctes(S.CLEANED, f"""x AS (SELECT 1)
SELECT {rsel(_QCOLS, _QCOLS)} FROM qs, bnd"""))
def q_quartiles(spark, sf_dir):
    st = cleaning.fit_stats(B.telemetry(spark, sf_dir))
    return round_doubles(cleaning.stats_frame(spark, st, _QCOLS))


_SENS = K.SENSOR_COLUMNS


@register("p_impute_median", S.with_ctes(S.CLEANED, f"""x AS (SELECT 1)
SELECT {rsel(KEYS + _SENS, _SENS)} FROM imputed"""))
def q_impute(spark, sf_dir):
    t = B.telemetry(spark, sf_dir)
    s = cleaning.fit_stats(t)
    return round_doubles(cleaning.impute_median(t, s, _SENS).select(*KEYS, *_SENS))


@register("p_clip_iqr", S.with_ctes(S.CLEANED, f"""x AS (SELECT 1)
SELECT {rsel(KEYS + _SENS, _SENS)} FROM capped"""))
def q_clip(spark, sf_dir):
    return round_doubles(cleaning.impute_and_cap(B.telemetry(spark, sf_dir)).select(*KEYS, *_SENS))


_FLAGS = [f"{c}_outlier" for c in K.CAPPED_COLUMNS]


@register("p_outlier_flag", S.with_ctes(S.CLEANED, "x AS (SELECT 1) SELECT " + ", ".join(KEYS) + ", "
                                        + ", ".join(f"NOT ({c} BETWEEN lo_{c} AND hi_{c}) AS {c}_outlier"
                                                    for c in K.CAPPED_COLUMNS)
                                        + " FROM imputed, bnd"))
def q_outliers(spark, sf_dir):
    return cleaning.impute_and_cap(B.telemetry(spark, sf_dir), with_flags=True).select(*KEYS, *_FLAGS)


def _feature_subset(cols: list[str], doubles: list[str] | None = None):
    doubles = cols if doubles is None else doubles

    def q(spark, sf_dir):
        return round_doubles(featured(spark, sf_dir).select(*KEYS, *cols))

    sql = S.with_ctes(S.FEATURES, f"x AS (SELECT 1) SELECT {rsel(KEYS + cols, doubles)} FROM features")
    return q, sql


for _key, _cols in {
    "p_interactions": ["vib_temp_interaction", "vib_press_ratio", "rpm_vib_ratio"],
    "w_temp_mean_6": ["temp_roll_mean_6h"], "w_temp_mean_24": ["temp_roll_mean_24h"],
    "w_temp_std_6": ["temp_roll_std_6h"], "w_temp_std_24": ["temp_roll_std_24h"],
    "w_vib_mean_6": ["vib_roll_mean_6h"], "w_vib_mean_24": ["vib_roll_mean_24h"],
    "w_vib_max_6": ["vib_roll_max_6h"], "w_vib_max_24": ["vib_roll_max_24h"],
    "w_press_mean_6": ["press_roll_mean_6h"], "w_press_mean_24": ["press_roll_mean_24h"],
    "a_group_machine": ["temp_roll_mean_6h", "vib_roll_max_6h"],
    "p_feature_cols": S.FEATURE_COLUMNS,
}.items():
    _fn, _sql = _feature_subset(_cols)
    register(_key, _sql)(_fn)

_ALL = KEYS + ["is_failure", "failure_type"] + S.FEATURE_COLUMNS


@register("clean_features", S.with_ctes(S.FEATURES, f"x AS (SELECT 1) SELECT {rsel(_ALL, S.FEATURE_COLUMNS)} "
                                                  "FROM features"))
def q_clean_features(spark, sf_dir):
    return round_doubles(featured(spark, sf_dir).select(*_ALL))


@register("w_fill_forward_back", S.with_ctes(S.TELEMETRY, f"""x AS (SELECT 1)
SELECT {', '.join(KEYS)}, {S.fill_sql('temperature', 'temperature_filled')},
       {S.fill_sql('vibration', 'vibration_filled')} FROM telemetry"""))
def q_fill(spark, sf_dir):
    t = B.telemetry(spark, sf_dir)
    return features.fill_forward_back(t, ORDER, ["temperature", "vibration"]) \
        .select(*KEYS, "temperature_filled", "vibration_filled")


@register("w_true_lag", S.with_ctes(S.CLEANED, f"""x AS (SELECT 1)
SELECT {', '.join(KEYS)},
  round(lag(temperature) OVER (PARTITION BY machine_id ORDER BY ts, k1, k2, k3), 6) AS temperature_prev,
  round(lag(vibration) OVER (PARTITION BY machine_id ORDER BY ts, k1, k2, k3), 6) AS vibration_prev
FROM capped"""))
def q_true_lag(spark, sf_dir):
    c = cleaning.impute_and_cap(B.telemetry(spark, sf_dir))
    return round_doubles(features.true_lag(c, ORDER, ["temperature", "vibration"])
                         .select(*KEYS, "temperature_prev", "vibration_prev"))


@register("f_machine", S.with_ctes(S.FEATURES, f"""x AS (SELECT 1)
SELECT {rsel(KEYS + S.FEATURE_COLUMNS, S.FEATURE_COLUMNS)} FROM features
WHERE machine_id = 'MCH-02 Hydraulic Press #1'"""))
def q_machine(spark, sf_dir):
    """One machine's feature rows: statistics of all readings, but only that machine is read for the rest."""
    stats = cleaning.fit_stats(B.telemetry(spark, sf_dir))
    f = features.engineer_features(B.telemetry(spark, sf_dir, "MCH-02 Hydraulic Press #1"), ORDER, stats=stats)
    return round_doubles(f.select(*KEYS, *S.FEATURE_COLUMNS))


@register("f_null_group_drop", S.with_ctes(S.CLEANED.replace(
    "FROM telemetry t, st", "FROM (SELECT * REPLACE (CASE WHEN k3 % 97 = 0 THEN NULL ELSE machine_id END "
                            "AS machine_id) FROM telemetry) t, st"), """x AS (SELECT 1)
SELECT count(*) AS n_rows, count(DISTINCT machine_id) AS n_machines,
       CAST(sum(CASE WHEN machine_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null_machine
FROM capped WHERE machine_id IS NOT NULL"""))
def q_null_group(spark, sf_dir):
    t = B.telemetry(spark, sf_dir).withColumn(
        "machine_id", F.when(F.col("k3") % 97 == 0, F.lit(None)).otherwise(F.col("machine_id")))
    f = features.engineer_features(t, ORDER)
    return f.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("machine_id").alias("n_machines"),
                 F.sum(F.col("machine_id").isNull().cast("long")).alias("n_null_machine"))


@register("w_global_index", S.with_ctes(S.FEATURES, f"""n AS (SELECT count(*) AS n FROM features)
SELECT machine_id, k1, k2, k3,
  row_number() OVER (ORDER BY ts, machine_id, k1, k2, k3) - 1 AS row_index,
  CASE WHEN row_number() OVER (ORDER BY ts, machine_id, k1, k2, k3) - 1 < floor(n * {_TRAIN_END!r}) THEN 'train'
       WHEN row_number() OVER (ORDER BY ts, machine_id, k1, k2, k3) - 1 < floor(n * {_VAL_END!r}) THEN 'val'
       ELSE 'test' END AS split
FROM features, n"""))
def q_global_index(spark, sf_dir):
    pos, ends = features.split_positions(keyed_telemetry(spark, sf_dir), ["ts", "machine_id", "k1", "k2", "k3"])
    return pos.select("machine_id", "k1", "k2", "k3", "row_index", features.split_name("row_index", ends).alias("split"))


@register("t_split_slice", S.with_ctes(S.FEATURES, f"""n AS (SELECT count(*) AS n FROM features),
idx AS (SELECT *, row_number() OVER (ORDER BY ts, machine_id, k1, k2, k3) - 1 AS ri FROM features, n)
SELECT CASE WHEN ri < floor(n * {_TRAIN_END!r}) THEN 'train' WHEN ri < floor(n * {_VAL_END!r}) THEN 'val' ELSE 'test' END
         AS split,
       count(*) AS n_rows, CAST(sum(is_failure) AS BIGINT) AS n_failures,
       min(ts) AS first_ts, max(ts) AS last_ts
FROM idx GROUP BY 1"""))
def q_split_slice(spark, sf_dir):
    s = features.with_split(keyed_telemetry(spark, sf_dir), ["ts", "machine_id", "k1", "k2", "k3"])
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.sum("is_failure").cast("long").alias("n_failures"),
                                  F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@register("a_row_count", S.with_ctes(S.FEATURES, f"""x AS (SELECT 1)
SELECT count(*) AS n, CAST(floor(count(*) * {_TRAIN_END!r}) AS BIGINT) AS train_end,
       CAST(floor(count(*) * {_VAL_END!r}) AS BIGINT) AS val_end FROM features"""))
def q_row_count(spark, sf_dir):
    f = keyed_telemetry(spark, sf_dir)
    n = F.count(F.lit(1))
    return f.agg(n.alias("n"), F.floor(n * _TRAIN_END).cast("long").alias("train_end"),
                 F.floor(n * _VAL_END).cast("long").alias("val_end"))


@register("t_sort_time", S.with_ctes(S.FEATURES, f"""x AS (SELECT 1)
SELECT {rsel(KEYS + ['temperature', 'temp_roll_mean_24h'], ['temperature', 'temp_roll_mean_24h'])}
FROM features ORDER BY ts, machine_id, k1, k2, k3"""))
def q_sort_time(spark, sf_dir):
    f = featured(spark, sf_dir).select(*KEYS, "temperature", "temp_roll_mean_24h")
    return round_doubles(f.orderBy("ts", "machine_id", "k1", "k2", "k3"))


@register("t_head_10", S.with_ctes(S.FEATURES, f"""x AS (SELECT 1)
SELECT {rsel(_ALL, S.FEATURE_COLUMNS)} FROM features ORDER BY ts, machine_id, k1, k2, k3 LIMIT 10"""))
def q_head(spark, sf_dir):
    f = featured(spark, sf_dir).orderBy("ts", "machine_id", "k1", "k2", "k3").limit(10)
    return round_doubles(f.select(*_ALL))


@register("w_last_49", S.with_ctes(S.FEATURES, f"""x AS (SELECT 1)
SELECT {rsel(KEYS + ['temperature', 'vibration', 'rn'], ['temperature', 'vibration'])} FROM (
  SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, k1 DESC, k2 DESC, k3 DESC) AS rn
  FROM features) WHERE rn <= 49"""))
def q_last_49(spark, sf_dir):
    """Top-49 per machine: Spark plans WindowGroupLimit on both sides of the shuffle,
    so a hot machine contributes at most 49 rows per map task."""
    w = Window.partitionBy("machine_id").orderBy(*[F.col(c).desc() for c in ORDER])
    f = featured(spark, sf_dir).withColumn("rn", F.row_number().over(w).cast("long")).where(F.col("rn") <= 49)
    return round_doubles(f.select(*KEYS, "temperature", "vibration", "rn"))


_SEQ_SQL = S.with_ctes(S.FEATURES, """seq AS (
  SELECT machine_id, ts, k1, k2, k3, is_failure,
    count(*) OVER w AS n, list(temperature) OVER w AS temps
  FROM features WINDOW w AS (PARTITION BY machine_id ORDER BY ts, k1, k2, k3
                             ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT machine_id, ts, k1, k2, k3, is_failure AS label, CAST(n AS INTEGER) AS seq_len,
  round(temps[1], 6) AS seq_first_temp, round(temps[12], 6) AS seq_last_temp,
  round(list_avg(temps), 6) AS seq_mean_temp
FROM seq WHERE n = 12""")


@register("w_sequence_12", _SEQ_SQL)
def q_sequences(spark, sf_dir):
    s = features.sequences(featured(spark, sf_dir), ORDER, S.FEATURE_COLUMNS, "is_failure", 12)
    temps = F.transform("sequence", lambda r: r[0])
    out = s.select("machine_id", "ts", "k1", "k2", "k3", F.col("is_failure").alias("label"),
                   F.size("sequence").alias("seq_len"), temps[0].alias("seq_first_temp"),
                   temps[11].alias("seq_last_temp"),
                   (F.aggregate(temps, F.lit(0.0), lambda a, x: a + x) / 12).alias("seq_mean_temp"))
    return round_doubles(out)


@register("a_histogram", S.with_ctes(S.FEATURES, """mm AS (SELECT min(vibration) AS lo, max(vibration) AS hi
                                                      FROM features),
b AS (SELECT least(25, CAST(floor((vibration - lo) / (hi - lo) * 25) AS INTEGER) + 1) AS bin, lo, hi
      FROM features, mm)
SELECT bin, round(lo + (hi - lo) * (bin - 1) / 25, 6) AS bin_start, count(*) AS n
FROM b GROUP BY bin, lo, hi"""))
def q_histogram(spark, sf_dir):
    f = featured(spark, sf_dir)
    mm = f.agg(F.min("vibration").alias("lo"), F.max("vibration").alias("hi")).first()
    lo, hi = F.lit(mm["lo"]), F.lit(mm["hi"])
    share = F.coalesce((F.col("vibration") - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0))  # one value: one bin
    b = F.least(F.lit(25), F.floor(share * 25).cast("int") + 1)
    out = f.select(b.alias("bin"), lo.alias("lo"), hi.alias("hi")).groupBy("bin", "lo", "hi") \
        .agg(F.count(F.lit(1)).alias("n"))
    return round_doubles(out.select("bin", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") - 1) / 25)
                                    .alias("bin_start"), "n"))


def _range_sql(hours: int) -> str:
    return S.with_ctes(S.CLEANED, f"""x AS (SELECT 1)
SELECT {', '.join(KEYS)},
  round(avg(temperature) OVER w, 6) AS temp_range_mean_{hours}h,
  round(max(vibration) OVER w, 6) AS vib_range_max_{hours}h, count(*) OVER w AS n_range_{hours}h
FROM capped WHERE machine_id IS NOT NULL
WINDOW w AS (PARTITION BY machine_id ORDER BY epoch(ts)
             RANGE BETWEEN {hours * 3600} PRECEDING AND CURRENT ROW)""")


def _range_query(hours: int):
    def q(spark, sf_dir):
        from shopfloor.operators.timeframes import time_range_features
        c = cleaning.impute_and_cap(B.telemetry(spark, sf_dir)).where(F.col("machine_id").isNotNull())
        out = time_range_features(c, "machine_id", "ts", hours * 3600, {
            f"temp_range_mean_{hours}h": ("avg", "temperature"),
            f"vib_range_max_{hours}h": ("max", "vibration"),
            f"n_range_{hours}h": ("count", "temperature")})
        return round_doubles(out.select(*KEYS, f"temp_range_mean_{hours}h", f"vib_range_max_{hours}h",
                                        f"n_range_{hours}h"))

    return q


register("w_time_range_6h", _range_sql(6))(_range_query(6))
register("w_time_range_24h", _range_sql(24))(_range_query(24))
