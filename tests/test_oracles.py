import pytest

from cropcube.plans import queries as Q
from tests.oracle import rows_of_spark, rows_of_sql


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, small, name):
    assert rows_of_spark(Q.QUERIES[name](spark, small)) == rows_of_sql(small, Q.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES) - {"model_gbm", "model_grid"}))
def test_query_without_sql_has_rows(spark, small, name):
    assert Q.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert {"NDVI_n96", "NDVI_16", "vclass", "tt"} <= set(df.columns) and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
