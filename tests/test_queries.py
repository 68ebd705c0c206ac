"""Every registered query against its SQL on the small tables; those without SQL give rows of a stable schema."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb
import pytest

from tidewright.plans import catalog

catalog.load_all()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    found = catalog.QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in found.collect())
    if name not in catalog.ORACLES:
        assert rows and found.schema == catalog.QUERIES[name](spark, sf).schema
        return
    told = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in told.fetchall())
    assert rows == want


def test_entry_module_names_and_columns(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
