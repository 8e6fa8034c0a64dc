"""Every query that has SQL gives the same rows in DuckDB."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from millrace import catalog

SQL = catalog.sql()


def rows(df: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    df = df[sorted(df.columns)]

    def one(v):
        if isinstance(v, (list, np.ndarray)):
            return str([one(x) for x in v])
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, (float, np.floating)) and np.isnan(v)):
            return None
        if isinstance(v, (float, np.floating)):
            return round(float(v), 8) + 0.0
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        return int(v) if isinstance(v, (int, np.integer)) else str(v)

    return list(df.columns), sorted((tuple(one(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, duck, name):
    got = rows(catalog.queries()[name](spark, sf).toPandas())
    want = rows(duck.execute(SQL[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
