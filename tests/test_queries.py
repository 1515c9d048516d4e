"""Every registered base query against its SQL twin, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from tessera.plans.registry import oracles, queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, str):
            return v
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return f"{float(v):.9g}"

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_matches_sql(spark, duck, name):
    assert rows(queries()[name](spark, FOLDER).toPandas()) == rows(duck.execute(oracles()[name]).df())
