"""Queries against their SQL, as the driver does, on the smallest tables."""

import numbers

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from loomgraph.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    cols = sorted(frame.columns)
    def show(v):
        if pd.isna(v):
            return "null"
        return f"{float(v):.6f}" if isinstance(v, numbers.Number) else str(v)

    return sorted(tuple(map(show, r)) for r in frame[cols].itertuples(index=False))


@pytest.fixture(scope="session")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, sf_dir, db, name):
    got, want = catalog.QUERIES[name](spark, sf_dir).toPandas(), db.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
