"""As-of joins against plain loops, with hot keys cut into chunks."""

import datetime as dt
import random

from shopfloor.functions.constants import SkewParams
from shopfloor.operators import asof

T0 = dt.datetime(2024, 1, 1)
DEFAULTS = {"rate": 1.0, "cost": 2.0}


def hours(n):
    return None if n is None else T0 + dt.timedelta(hours=n)


def brute(rows, params):
    out = []
    for i, k, t in rows:
        best = None
        for key, a, b, rate, cost in params:
            if key == k and t is not None and a <= t and (best is None or a > best[0]):
                best = (a, b, rate, cost)
        ok = best is not None and (best[1] is None or t < best[1])
        out.append((i, best[2] if ok and best[2] is not None else 1.0, best[3] if ok and best[3] is not None else 2.0))
    return sorted(out)


def test_equals_loops(spark):
    r = random.Random(3)
    params = [(k, a, None if r.random() < 0.4 else a + r.randrange(1, 60), None if r.random() < 0.2 else float(r.randrange(100)), float(a))
              for k in ("m1", "m2", None, "m4") for a in sorted(r.sample(range(0, 400), 9))]
    rows = [(i, r.choice(["m1", "m1", "m1", "m2", None, "m3"]), r.choice([r.randrange(-20, 450), r.randrange(0, 400)]) if i % 50 else None)
            for i in range(900)]
    df = spark.createDataFrame([(i, k, hours(t), "x") for i, k, t in rows], "i int, m string, ts timestamp_ntz, rates string").repartition(4)
    ps = spark.createDataFrame([(k, hours(a), hours(b), x, y) for k, a, b, x, y in params],
                               "m string, valid_from timestamp_ntz, valid_to timestamp_ntz, rate double, cost double")
    want = brute(rows, params)
    for skew in (SkewParams(), SkewParams(hot_rows=20, chunk_rows=17), SkewParams(hot_rows=1, chunk_rows=1)):
        got = asof.as_of_join(df, ps, "m", "ts", DEFAULTS, skew=skew)
        assert got.columns == [*df.columns, "rate", "cost"]
        assert sorted((x.i, x.rate, x.cost) for x in got.collect()) == want
    assert asof.as_of_join(df, ps.where("false"), "m", "ts", DEFAULTS).where("rate <> 1 OR cost <> 2").count() == 0
    assert asof.as_of_join(df.where("false"), ps, "m", "ts", DEFAULTS).count() == 0
