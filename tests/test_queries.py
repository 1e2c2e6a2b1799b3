import pytest

from quoinlake.plans.catalog import QUERIES, SQL
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
ROWS_ONLY = sorted(set(QUERIES) - set(SQL))


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SQL)
def test_query_matches_its_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], SQL[name], SF) == ""


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 15 and all(r["is_undervalued"] for r in rows)
    assert set(entry.oracle_sql()) <= set(entry.queries())
