"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from siftwood.plans import evidence as catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def told(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", [*catalogue.QUERIES])
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in catalogue.ORACLES:
        want = duck.execute(catalogue.ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert told(rows, df.columns) == told(want.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
