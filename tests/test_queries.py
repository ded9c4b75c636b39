"""Every registered table query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from kestrata.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted(names), sorted((tuple(clean(r[i]) for i in order) for r in values), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(ORACLE_SQL[name])
    assert found == rows([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())
