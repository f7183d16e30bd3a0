"""Every query of the engine against DuckDB's answer on the same tables."""

from pathlib import Path

import duckdb
import pytest

from tessella.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return str(float(v)) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    got = duck.execute(registry.ORACLE_SQL[name])
    at = [d[0] for d in got.description]
    assert sorted(at) == names
    theirs = sorted(tuple(plain(r[at.index(n)]) for n in names) for r in got.fetchall())
    assert mine == theirs
