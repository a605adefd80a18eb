"""Every registered query of the library against its SQL, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from compare import same, views  # noqa: E402

from stridelake.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    import duckdb

    return views(duckdb.connect(), SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE:
        same(df, con, registry.ORACLE[name])
    else:
        assert df.count() >= 0 and df.columns


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["p4_ids_by_sport"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "ReadSchema" in plan
    plan = registry.QUERIES["p13_excluded_ids"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan
