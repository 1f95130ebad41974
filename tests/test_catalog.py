"""Every registered query with SQL gives what DuckDB gives."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from gazette.plans import catalog


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_value, v))
    return v


def assert_same(df, sql, sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    c.execute(sql)
    names = [d[0] for d in c.description]
    want = Counter(tuple(_value(dict(zip(names, r))[k]) for k in sorted(names)) for r in c.fetchall())
    assert sorted(df.columns) == sorted(names)
    got = Counter(tuple(_value(r[k]) for k in sorted(names)) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_against_sql(spark, sf, name):
    assert_same(catalog.QUERIES[name](spark, sf), catalog.ORACLE[name], sf)


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "balanced_top20" in e.queries()
