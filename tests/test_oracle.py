import pytest

from lexiprobe import queries as base

from .oracle import connect, rows_of, sql_rows


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(base.SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    assert rows_of(base.QUERIES[name](spark, sf)) == sql_rows(con, base.SQL[name])


@pytest.mark.parametrize("name", sorted(set(base.QUERIES) - set(base.SQL)))
def test_model_query_predicts_every_held_row(spark, sf, name):
    rows = base.QUERIES[name](spark, sf).collect()
    assert rows and ("prediction" not in rows[0] or all(r["prediction"] is not None for r in rows))
