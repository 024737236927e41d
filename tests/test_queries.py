import pytest

from compare import database, of_duckdb, of_spark
from conftest import SF
from lexigrain.plans import queries


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    columns, found = of_spark(queries.QUERIES[name](spark, SF))
    assert found
    if name in queries.ORACLE_SQL:
        assert (columns, found) == of_duckdb(con, queries.ORACLE_SQL[name])


def test_all_languages_come_out_whole(spark):
    assert all(r.broken == 0 and r.sources == spark.read.parquet(f"{SF}/supplier.parquet").count() for r in queries.all_languages(spark, SF).collect())


def test_all_have_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["lexer", "type", "tokens", "chars"]
