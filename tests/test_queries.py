"""Every registered query of the relational part against its SQL."""

import pytest
from compare import of_duckdb, of_spark, oracle, types_that_differ

from brindle.catalog import ORACLE_SQL, QUERIES

#: Empty on the smallest tables.
MAY_BE_EMPTY = {"q18_large_orders", "j12_asof_join_tolerance"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows = of_spark(df)
    assert rows[1] or name in MAY_BE_EMPTY
    assert rows == of_duckdb(duck, ORACLE_SQL[name])
    assert not types_that_differ(df, duck, ORACLE_SQL[name])
