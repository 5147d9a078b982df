"""Every query of the library against its SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from lodestrata import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for t in TABLES:
        made.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 8) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = table([tuple(r) for r in df.collect()], df.columns)
    said = duck.sql(catalog.ORACLES[name])
    assert got == table(said.fetchall(), said.columns)


def test_every_oracle_has_a_query():
    assert catalog.ORACLES.keys() <= catalog.QUERIES.keys()
