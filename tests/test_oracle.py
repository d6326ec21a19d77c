"""Every registered query against its reference SQL on the smallest data."""

import math

import pytest

duckdb = pytest.importorskip("duckdb")

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from casetrail.plans import catalog  # noqa: E402

NAMES = sorted(catalog.load_all()[0])

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def second_engine(small):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    return v


def ordered(data):
    return sorted(data, key=lambda row: tuple((v is None, str(v)) for v in row))


def test_every_query_has_reference_sql():
    assert set(NAMES) <= set(queries()) and set(NAMES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, second_engine, name):
    frame = queries()[name](spark, small)
    columns = sorted(frame.columns)
    ours = [tuple(normal(r[c]) for c in columns) for r in frame.collect()]
    result = second_engine.execute(oracle_sql()[name])
    described = {d[0]: str(d[1]) for d in result.description}
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert {c: TYPES[t] for c, t in frame.dtypes} == described
    theirs = [tuple(normal(row[names.index(c)]) for c in columns) for row in result.fetchall()]
    assert ordered(ours) == ordered(theirs)
