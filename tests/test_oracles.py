"""Each query that SQL can express gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from tests.conftest import DATA

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return str(value)[:19] if hasattr(value, "isoformat") else value


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    found = entry.queries()[name](spark, DATA)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(found.columns) == sorted(names)
    assert ordered(tuple(r) for r in found.select(*names).collect()) == ordered(cur.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
