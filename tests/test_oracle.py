"""Every graph query against its SQL on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from tracery.plans.oracle import SQL
from tracery.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


def plain(df):
    def text(v):
        return "-" if pd.api.types.is_scalar(v) and pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(spark, duck, sf, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)
