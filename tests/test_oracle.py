"""Every registered query against its SQL twin in DuckDB."""

import re

import pytest

import __spark_entry__ as contract
import check
from crashgrid.plans import catalog


@pytest.fixture(scope="module")
def con(small):
    return check.duck(small)


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def no_pair_joins_and_no_python(df):
    """Nothing in the physical plan that breaks down on large tables."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "EvalPython" not in plan and "MapInPandas" not in plan
    # A window without partitions would pull everything into one task.
    for partitions in re.findall(r"Window \[.*?\], \[(.*?)\]", plan):
        assert partitions


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, con, small, name):
    ok, text = check.compare(spark, con, small, name, no_pair_joins_and_no_python)
    assert ok, text


def test_entry_has_rows_and_schema(spark):
    df = contract.entry(spark)
    assert df.columns == ["cx", "cy", "lon", "lat", "point_count", "radius", "size_label"]
    rows = df.collect()
    assert sum(r.point_count for r in rows) == 214
    counts = [r.point_count for r in rows]
    assert counts == sorted(counts)
