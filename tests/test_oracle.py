"""Every registered query against its DuckDB oracle on the driver tables
(the same comparison the driver makes: row count, column names, exact values
with columns sorted by name, order-insensitive). Queries without an oracle
must run and return rows."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry_mod
from tests.conftest import SF_SMALL
from tidewater.sources.tables import TABLES

QUERIES = entry_mod.queries()
ORACLE = entry_mod.oracle_sql()


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert rows, f"{name} returned no rows"
        return
    res = duck.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert _canon(df.columns, rows) == _canon(dcols, drows)


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert [c for c in df.columns] == ["horizon", "mse", "n_windows"]
    assert len(rows) == 16
    assert all(r.n_windows == rows[0].n_windows for r in rows)
