"""Every registered query of the core against its SQL in DuckDB, at the smallest scale."""

import os

import pytest

from memlake import plans, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 6) + 0.0)
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    out = con.execute(registry.ORACLES[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in out.fetchall())
    assert got == want
