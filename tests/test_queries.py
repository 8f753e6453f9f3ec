"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import duckdb
import pytest

import __spark_entry__ as engine
from ledgerloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: "null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([c[0] for c in cursor.description], cursor.fetchall())


def test_entry_has_rows(spark):
    assert engine.entry(spark).count() > 0


def test_names():
    assert set(engine.oracle_sql()) <= set(engine.queries())
