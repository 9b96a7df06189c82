"""Every check query against its SQL on the smallest tables, with a look at its plan."""

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    status, note = check.compare(spark, con, name, SF_DIR, {name: lambda *_: df}, oracle_sql())
    assert status in ("ok", "rows"), note


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["season", "lat", "lon", "value", "n"] and df.count() > 0
