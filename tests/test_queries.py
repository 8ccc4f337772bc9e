"""Every registered query of the reference's own operators against its SQL in DuckDB."""

import duckdb
import pytest

from canonry.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    return round(float(value), 6) if isinstance(value, float) or hasattr(value, "as_tuple") else value


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.sql(queries.ORACLE[name])
    assert sorted(want.columns) == columns
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    wanted = sorted((tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()), key=repr)
    assert rows == wanted


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
