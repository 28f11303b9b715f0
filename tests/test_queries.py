"""Every query of the engine gives the rows of its SQL; those without SQL have rows and a stable schema."""

import pytest
from conftest import rows_of, rows_of_sql

from quillon.plans import QUERIES, SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        assert rows_of(df) == rows_of_sql(duck, SQL[name])
    elif name == "eval_matrix":
        assert df.schema == QUERIES[name](spark, sf).schema  # its rows: test_engine
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "passage_id", "score", "rank"] and df.count() > 0
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
