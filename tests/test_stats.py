from pyspark.sql import functions as F

from shopfloor.functions.constants import CleaningParams
from shopfloor.operators import cleaning
from shopfloor.sources import bindings as B

from conftest import SF_SMALL


def test_stats_equal_percentile(spark):
    """The histogram path equals Spark's exact percentile on the raw and on the imputed columns."""
    t = B.telemetry(spark, SF_SMALL)
    got = cleaning.fit_stats(t)
    sensors = ["temperature", "vibration", "pressure", "rpm", "voltage"]
    med = t.agg(*[F.percentile(c, 0.5).alias(c) for c in sensors]).first()
    for c in sensors:
        assert abs(got[f"med_{c}"] - med[c]) < 1e-9
    capped = [k[3:] for k in got if k.startswith("q1_")]
    quart = t.fillna({c: med[c] for c in sensors}).agg(*[F.percentile(c, [0.25, 0.75]).alias(c) for c in capped]).first()
    for c in capped:
        assert abs(got[f"q1_{c}"] - quart[c][0]) < 1e-9 and abs(got[f"q3_{c}"] - quart[c][1]) < 1e-9


def test_interpolated_median_between_values_and_empty_columns(spark):
    p = CleaningParams(sensors=("v", "w"), capped=("v", "w"))
    df = spark.createDataFrame([(1.0, None), (4.0, None), (None, None), (None, None), (None, None)], "v double, w double")
    st = cleaning.fit_stats(df, p)
    assert (st["med_v"], st["q1_v"], st["q3_v"], st["nulls_v"]) == (2.5, 2.5, 2.5, 3)
    assert st["med_w"] is None and st["q1_w"] is None and st["nulls_w"] == 5


def test_quartiles_use_imputed_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (None,), (10.0,)], "v double")
    p = CleaningParams(sensors=("v",), capped=("v",))
    st = cleaning.fit_stats(df, p)
    # imputed column: 1, 2, 2, 2, 10 -> q1 = 2, q3 = 2
    assert (st["med_v"], st["q1_v"], st["q3_v"]) == (2.0, 2.0, 2.0)


def test_exact_ranks_of_awkward_columns(spark, monkeypatch):
    """Any rank of any column, with ties, outliers and tiny differences, also when brackets must be sketched again."""
    import random

    from shopfloor.operators import quantiles as Q
    r = random.Random(2)
    n = 20_000
    columns = {"same": [3.0] * n, "spread": [r.gauss(0, 1) for _ in range(n)], "wide": [10.0 ** r.randrange(-300, 300) * r.choice([-1, 1]) for _ in range(n)],
               "few": [float(r.choice([1, 1, 1, 2, 9])) for _ in range(n)], "close": [1.0 + 1e-15 * r.randrange(50) for _ in range(n)],
               "gaps": [None if r.random() < 0.3 else float(k) for k in range(n)]}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(5)
    ordered = {c: sorted(v for v in vs if v is not None) for c, vs in columns.items()}
    ranks = {c: {0, 1, 2, len(v) // 4, len(v) // 2, len(v) - 2, len(v) - 1} for c, v in ordered.items()}
    for most in (Q.MOST_VALUES, 50):
        monkeypatch.setattr(Q, "MOST_VALUES", most)
        sketches = Q.sketch_columns(df, list(columns))
        got = Q.values_at(df, sketches, ranks)
        for c, rs in ranks.items():
            assert sketches[c].n == len(ordered[c]) and sketches[c].nulls == n - len(ordered[c])
            for k in rs:
                v = got[c, k]
                assert v.value == ordered[c][k] and v.count == ordered[c].count(v.value) and ordered[c].index(v.value) == v.before
    assert Q.values_at(df, sketches, {c: set() for c in columns}) == {}


def test_quartiles_of_imputed_columns_equal_percentile(spark):
    import random
    r = random.Random(9)
    for share in (0.0, 0.2, 0.6, 0.95):
        data = [(None if r.random() < share else float(r.choice([1, 2, 2, 3, 50, r.randrange(100)])),) for _ in range(301)]
        df = spark.createDataFrame(data, "v double")
        st = cleaning.fit_stats(df, CleaningParams(sensors=("v",), capped=("v",)))
        want = df.fillna({"v": st["med_v"]}).agg(F.percentile("v", [0.25, 0.75]).alias("q")).first().q
        assert (st["q1_v"], st["q3_v"]) == (want[0], want[1])
