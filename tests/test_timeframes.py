"""Time-range frames against plain loops, dense machines, cells of bounded rows."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from shopfloor.functions.constants import SkewParams
from shopfloor.operators import timeframes as TF

SPEC = {"a": ("avg", "v"), "s": ("sum", "v"), "n": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v")}
T0 = dt.datetime(2024, 1, 1)


def brute(rows, seconds):
    out = []
    for k, t, v, i in rows:
        same = [x for kk, tt, x, _ in rows if kk == k and ((t is None and tt is None) or (
            t is not None and tt is not None and t - dt.timedelta(seconds=seconds) <= tt <= t)) and x is not None]
        out.append((i, round(sum(same) / len(same), 6) if same else None, round(sum(same), 6) if same else None, len(same),
                    min(same, default=None), max(same, default=None)))
    return sorted(out)


def got(df):
    return sorted((r.i, round(r.a, 6) if r.a is not None else None, round(r.s, 6) if r.s is not None else None, r.n, r.lo, r.hi)
                  for r in df.collect())


def test_equals_loops_on_every_path(spark):
    r = random.Random(6)
    rows = []
    for i in range(500):
        t = T0 + dt.timedelta(seconds=r.choice([r.randrange(0, 4000), 60 * r.randrange(60)]), microseconds=r.choice([0, 0, 1, 999_999]))
        rows.append((r.choice(["a", "b", "b", "b", None]), r.choice([t, t, t, t, t, None]) if i % 40 == 0 else t,
                     None if r.random() < 0.1 else float(r.randrange(1000)) / 4, i))
    rows += [("edge", T0 + dt.timedelta(seconds=600 * k), float(k), 1000 + k) for k in range(6)]
    rows += [("old", dt.datetime(1960, 1, 1) + dt.timedelta(seconds=299 * k), float(k), 2000 + k) for k in range(9)]
    df = spark.createDataFrame(rows, "m string, ts timestamp_ntz, v double, i int").repartition(5)
    for seconds in (600, 37):
        want = brute(rows, seconds)
        for skew in (SkewParams(), SkewParams(hot_rows=2, chunk_rows=10**6), SkewParams(hot_rows=20, chunk_rows=3)):
            assert got(TF.time_range_features(df, "m", "ts", seconds, SPEC, skew)) == want


def test_cells_stay_bounded(spark):
    stamps = spark.range(100_000).selectExpr("'m' as m", "id * 1000000 as _us")
    m = TF._cells_needed(stamps, "m", 86_400 * 1_000_000, 5_000)
    assert m == 32  # 2,700 readings a cell
    assert TF._cells_needed(stamps.where("false"), "m", 1_000_000, 10) == 1


def test_cost_does_not_depend_on_readings_per_range(spark):
    """One machine at 1 Hz for three days: 24 h frames (86,400 readings each) take about as long as 10 min
    frames (600 each); frame by frame that would be 144 times the work."""
    df = spark.range(3 * 86_400).select(F.lit("m").alias("m"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 100).cast("double").alias("v"))

    def run(seconds):
        began = time.time()
        out = TF.time_range_features(df, "m", "ts", seconds, SPEC, SkewParams(hot_rows=100_000, chunk_rows=20_000)) \
            .agg(F.max("n").alias("n"), F.max("a").alias("a")).first()
        return time.time() - began, out
    run(60)
    short, a = run(600)
    long, b = run(86_400)
    assert (a.n, b.n) == (601, 86_401)
    assert long < 5 * short + 5
