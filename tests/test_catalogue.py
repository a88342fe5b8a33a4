"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from tessella.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, float):
        return f"{v:.5g}" if abs(v) > 1 else f"{round(v, 5) + 0.0:.5f}"
    return str([norm(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, duck, name):
    out = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(out.columns)
    expected = found.fetchall()
    rows = out.select(*columns).collect()
    assert sorted(tuple(map(norm, r)) for r in rows) == sorted(tuple(map(norm, r)) for r in expected)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
