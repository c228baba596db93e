"""Every query with SQL against DuckDB on the same tables; the others for their shape."""

import math

import duckdb
import pytest

from quillspark.plans import registry

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW: set[str] = set()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for n in NAMES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{small}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, small, con, name):
    got = registry.QUERIES[name](spark, small)
    cur = con.execute(registry.ORACLES[name])
    cols = [x[0] for x in cur.description]
    assert sorted(got.columns) == sorted(cols)
    want = sorted(tuple(cell(v) for _, v in sorted(zip(cols, r))) for r in cur.fetchall())
    assert sorted(tuple(cell(r[c]) for c in sorted(cols)) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - SLOW))
def test_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0
