"""Every query of the reference's operators against its SQL."""

import os

import pytest
from support import DATA, same

from syllabrook import queries as q

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    same(q.queries()[name](spark, DATA), duck, q.oracle_sql()[name])


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(q.oracle_sql()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_chunks_cover_the_text_again(spark):
    rows = q.queries()["paragraph_chunks"](spark, DATA).collect()
    assert rows and all(0 < len(r["chunk"]) <= 500 + 102 for r in rows)


def test_filters_reach_the_scan(spark):
    plan = q.queries()["coverage_zero"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,49.0)" in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan
