"""Every registered query against its SQL on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidewell.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def tables(folder):
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return str([plain(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return ""
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float, np.number)) else str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, tables):
    got = QUERIES[name](spark, folder).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = tables.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
