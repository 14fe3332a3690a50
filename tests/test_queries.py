import pytest

from rowmend import catalog
from tools.check_queries import compare, connect

ORACLES = catalog.oracle_sql()
QUERIES = catalog.queries()
# compared with their SQL by the query tool only: each takes minutes on a small machine
SLOW = {"grid_summary", "fit_svd", "fit_ppcam", "fit_pcada"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    cursor = con.execute(ORACLES[name])
    assert compare(df.columns, rows, [d[0] for d in cursor.description], cursor.fetchall()) == "ok"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["select_filter", "impute_interpolate_series", "contrib_chiang", "nrmse_variable", "cells_long"])
def test_plans_have_no_cross_joins(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns(spark, sf):
    plan = QUERIES["select_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_linenumber" not in plan and "o_orderpriority" not in plan and "l_shipdate" not in plan
