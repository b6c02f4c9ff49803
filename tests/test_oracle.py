"""Every registered query against its SQL, on the smallest scale by default."""

import os

import oracle
import pytest

from armature.catalog import QUERIES, SQL

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
#: Empty on the smallest scale, where no row meets the condition.
MAY_BE_EMPTY = {"never_triggered", "joint_coverage", "stream_pairs"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    problem = oracle.compare(QUERIES[name](spark, SF_DIR), con, SQL[name])
    if problem == "both are empty" and name in MAY_BE_EMPTY:
        return
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
