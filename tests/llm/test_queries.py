"""Every query of the subpackage against its SQL on small driver tables."""

import pytest

from cohortloom.llm.queries import QUERIES
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [name for name, (_, sql) in QUERIES.items() if sql])
def test_query_matches_sql(spark, con, name):
    query, sql = QUERIES[name]
    assert difference(query(spark, FOLDER), con, sql) == ""
