"""Every registered query with a SQL twin gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from memlake.plans import registry

SQL = sorted(registry.ORACLES)


def cells(df: pd.DataFrame) -> list[str]:
    def text(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(text, v)) + "]"
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "-"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return repr(round(float(v), 6))
        return str(v)

    return sorted("|".join(text(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", SQL)
def test_oracle(name, spark, sf, duck):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


def test_every_query_is_registered_once():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) > 90
