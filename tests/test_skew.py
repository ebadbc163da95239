"""The hot-key paths (position chunks with overlap, time buckets with context) must give
exactly the plain-window results."""

from pyspark.sql import functions as F

from shopfloor.functions.constants import SkewParams
from shopfloor.operators import features
from shopfloor.operators.positions import row_positions, running_totals
from shopfloor.operators.timeframes import time_range_features
from shopfloor.sources import bindings as B

from conftest import SF_SMALL

KEYS = ["machine_id", "k1", "k2", "k3"]


def _rows(df, cols):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


def test_rolling_hot_path_equals_plain(spark):
    raw = B.telemetry(spark, SF_SMALL)
    cols = KEYS + features.feature_names()
    plain = features.engineer_features(raw, B.TELEMETRY_ORDER)
    hot = features.engineer_features(raw, B.TELEMETRY_ORDER, skew=SkewParams(hot_rows=3, chunk_rows=25))
    assert _rows(plain, cols) == _rows(hot, cols)


def test_fill_carry_across_chunks(spark):
    raw = B.telemetry(spark, SF_SMALL).withColumn(
        "vibration", F.when(F.col("k1") % 3 == 0, F.lit(None)).otherwise(F.col("vibration")))
    cols = KEYS + ["vibration_filled", "temperature_filled"]
    plain = features.fill_forward_back(raw, B.TELEMETRY_ORDER, ["vibration", "temperature"])
    hot = features.fill_forward_back(raw, B.TELEMETRY_ORDER, ["vibration", "temperature"],
                                     skew=SkewParams(hot_rows=2, chunk_rows=2))
    assert _rows(plain, cols) == _rows(hot, cols)


def test_sequences_hot_path(spark):
    f = features.engineer_features(B.telemetry(spark, SF_SMALL), B.TELEMETRY_ORDER)
    a = features.sequences(f, B.TELEMETRY_ORDER, ["temperature"], "is_failure", 12)
    b = features.sequences(f, B.TELEMETRY_ORDER, ["temperature"], "is_failure", 12,
                           skew=SkewParams(hot_rows=5, chunk_rows=13))
    cols = KEYS + [F.to_json("sequence")]
    assert _rows(a, cols) == _rows(b, cols)


def test_time_range_hot_path(spark):
    t = B.telemetry(spark, SF_SMALL)
    spec = {"m": ("avg", "temperature"), "n": ("count", "temperature")}
    a = time_range_features(t, "machine_id", "ts", 6 * 86400, spec)
    b = time_range_features(t, "machine_id", "ts", 6 * 86400, spec, skew=SkewParams(hot_rows=3, chunk_rows=2))
    assert _rows(a, KEYS + ["m", "n"]) == _rows(b, KEYS + ["m", "n"])


def test_row_positions_match_row_number(spark):
    from pyspark.sql import Window
    t = B.telemetry(spark, SF_SMALL)
    got = row_positions(t, ["ts", "machine_id", "k1", "k2", "k3"], (), "pos")
    want = t.withColumn("pos", F.row_number().over(Window.orderBy("ts", "machine_id", "k1", "k2", "k3")) - 1)
    assert _rows(got, KEYS + ["pos"]) == _rows(want, KEYS + ["pos"])
    got_g = row_positions(t, ["ts", "k1", "k2", "k3"], ["machine_id"], "pos", num_partitions=5)
    want_g = t.withColumn("pos", F.row_number().over(
        Window.partitionBy("machine_id").orderBy("ts", "k1", "k2", "k3")) - 1)
    assert _rows(got_g, KEYS + ["pos"]) == _rows(want_g, KEYS + ["pos"])


def test_running_totals(spark):
    from pyspark.sql import Window
    t = B.telemetry(spark, SF_SMALL).select("machine_id", "k1", "k2", "k3", F.col("k2").cast("long").alias("w"))
    got = running_totals(t, ["k1", "k2", "k3"], ["w"], ["machine_id"], num_partitions=6)
    w = Window.partitionBy("machine_id").orderBy("k1", "k2", "k3")
    want = t.select("*", F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                    .alias("w_before"), F.sum("w").over(Window.partitionBy("machine_id")).alias("w_total"))
    assert _rows(got, KEYS + ["w_before", "w_total"]) == _rows(want, KEYS + ["w_before", "w_total"])


def test_null_keys_keep_every_row(spark):
    """NULL is a key like any other, normal or hot."""
    raw = B.telemetry(spark, SF_SMALL)
    for share in (3,):  # a third of all rows has no machine
        t = raw.withColumn("machine_id", F.when(F.col("k3") % share != 0, F.col("machine_id")))
        out = {}
        for hot_rows in (10**9, 20):
            skew = SkewParams(hot_rows=hot_rows, chunk_rows=50)
            lagged = features.true_lag(t, B.TELEMETRY_ORDER, ["temperature"], skew=skew)
            filled = features.fill_forward_back(t, B.TELEMETRY_ORDER, ["vibration"], skew=skew)
            assert lagged.count() == filled.count() == raw.count()
            out[hot_rows] = (_rows2(lagged, [*KEYS, "temperature_prev"]), _rows2(filled, [*KEYS, "vibration_filled"]))
        assert out[10**9] == out[20]


def _rows2(df, cols):
    return sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.select(*cols).collect())
