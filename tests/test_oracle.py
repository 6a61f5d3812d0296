"""Every registered query against DuckDB on the same tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest

from lumensift.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(x) for x in r) for r in df.select(*columns).collect())
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    theirs = Counter(tuple(plain(x) for x in r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert ours == theirs
