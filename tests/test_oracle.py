"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest
from oracle import DATA, rows, tables

from nearfield.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck():
    return tables()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["window_end", "W", "S", "R", "k", "id"]


def test_whole_table_of_lines(spark):
    """Every row is a point, and outliers of the last years are reported."""
    from nearfield.sources.points import line_points

    table = spark.read.parquet(f"{DATA}/lineitem.parquet")
    assert line_points(spark, DATA).count() == table.count()
    last = table.selectExpr("max(unix_micros(cast(l_shipdate as timestamp))) as a").first()["a"]
    assert QUERIES["multi_dim_outliers_whole"](spark, DATA).where(f"window_end > {last}").count() > 0
