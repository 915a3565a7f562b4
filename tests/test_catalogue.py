"""Every query of the engine on the smallest tables, against its DuckDB oracle where it has one."""

import decimal
import glob
import os

import duckdb
import pytest

from lectern import catalogue

SF = "/root/testdata/sf0.001"
ORACLES = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return plain(float(v)) if v != v.to_integral_value() else int(v)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    names = sorted(df.columns)
    found = [tuple(plain(r[x]) for x in names) for r in df.collect()]
    if name not in ORACLES:
        return
    oracle = duck.sql(ORACLES[name])
    assert sorted(oracle.columns) == names
    at = [oracle.columns.index(x) for x in names]
    assert ordered(found) == ordered([tuple(plain(r[i]) for i in at) for r in oracle.fetchall()])


def test_oracles_belong_to_queries():
    assert not set(ORACLES) - set(catalogue.queries())
