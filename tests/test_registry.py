"""Every registered query against its SQL on the smallest tables."""

from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from vellum.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, Decimal)):
        return round(float(value), 4)
    return value


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows(spark, duck, name):
    found = registry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in found.collect())
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert got == Counter(tuple(plain(row[i]) for i in order) for row in want.fetchall())
