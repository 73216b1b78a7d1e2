"""Every query with SQL gives the rows of its SQL on the small tables."""

import oracle
import pytest

from corpusloom.plans.table_queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    query = QUERIES[name]
    if query.sql is None:
        assert query.run(spark, SF_DIR).count() > 0
    else:
        assert oracle.compare(spark, con, SF_DIR, query.run, query.sql) == ""
