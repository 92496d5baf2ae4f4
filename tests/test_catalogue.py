import pytest

import __spark_entry__
from docvet.plans import catalogue
from tests.oracle import same


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    same(catalogue.QUERIES[name](spark, sf), catalogue.ORACLE_SQL[name], sf)


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 50 and {r.label for r in rows} <= {"safe", "caution", "dangerous"}
