"""Every query with SQL gives what DuckDB gives for it on the same tables."""

import duckdb
import pytest

from pramana.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, int, str)):
        return v
    try:
        return round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got
    if name in registry.SQL:
        q = con.execute(registry.SQL[name])
        names = [d[0] for d in q.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in q.fetchall()), key=str)
        assert got == want
