"""Every query against the SQL that must give the same rows."""

import math

import duckdb
import pytest

from loomframe import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in df.collect())
    if name not in registry.SQL:
        assert got
        return
    found = duck.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(_plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
