import duckdb
import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

ORACLE_KEYS = sorted(E.oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "failure_probability" in df.columns


def test_every_query_has_a_unique_key():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) > 100


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in E.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", ORACLE_KEYS)
def test_oracle_small(spark, con, key):
    """Every registered query that has SQL, against it."""
    from tools.oracle_check import rows_of
    s = E.queries()[key](spark, SF_SMALL).toPandas()
    o = con.execute(E.oracle_sql()[key]).df()
    assert rows_of(s) == rows_of(o)


PLAN_KEYS = ["w_latest_reading", "j_scenarios", "t_evidence_topk", "j_event_fanin", "p_surface_verdict",
             "w_time_range_6h", "j_unreviewed", "a_histogram"]


@pytest.mark.parametrize("key", PLAN_KEYS)
def test_no_cross_products(spark, key):
    plan = E.queries()[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
