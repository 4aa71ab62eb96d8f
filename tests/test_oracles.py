"""Every query that has SQL gives the rows that DuckDB gives for it."""

import math

import pytest

from siltstone.plans import all_queries, all_sql

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.8g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same(df, result):
    columns = sorted(df.columns)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())
    assert rows == want


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(name, spark, duck):
    df = all_queries()[name](spark, DATA)
    if name in all_sql():
        same(df, duck.execute(all_sql()[name]))
    else:
        assert df.count() > 0  # their values are held against plain versions in test_plain_versions.py
