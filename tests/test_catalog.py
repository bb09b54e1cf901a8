"""Every query against its SQL twin on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from skyrill.plans import catalog

SF = "/root/testdata/sf0.001"

ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "-"
        return f"{float(x):.5g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(norm(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, duck):
    df = catalog.queries()[name](spark, SF)
    ref = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(ref.columns)
    assert rows(df.columns, df.collect()) == rows(ref.columns, ref.fetchall())


def test_every_key_is_a_query():
    assert set(ORACLES) <= set(catalog.queries())
