"""Every registered query against its SQL, and the shape of its plan."""

import re

import pytest
from check_queries import compare, connect

from quotelake.plans import registry

NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf_dir, name):
    diff, _ = compare(spark, con, registry.QUERIES[name], registry.ORACLES.get(name), sf_dir)
    if name not in registry.ORACLES and diff == "no rows":
        diff = None
    assert diff is None, diff


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith("stream_")])
def test_plan_has_no_cross_join_and_no_python(spark, sf_dir, name):
    """With Spark's own broadcasts off, as for tables too large for one, the
    only broadcast left is that of the hot groups, whose size is bounded."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for bad in ("CartesianProduct", "BroadcastNestedLoop", "EvalPython", "PythonUDF", "MapInPandas"):
        assert bad not in plan
    assert plan.count("BroadcastExchange") == len(re.findall(r"\(_n#\d+L > ", plan))


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
