"""Every registered query against its SQL, and its plan against shapes that do not scale."""

import contextlib
import io
import os

import pytest
from check_queries import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    printed = io.StringIO()
    with contextlib.redirect_stdout(printed):
        df.explain("formatted")
    plan = printed.getvalue()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name in ORACLE:
        assert compare(df, con, ORACLE[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_oracle_names():
    assert set(ORACLE) <= set(QUERIES)
