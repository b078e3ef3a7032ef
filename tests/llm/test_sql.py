"""Queries with SQL give what DuckDB gives for it on the same tables."""

import duckdb
import pytest

from pramana.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_and_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    q = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    got = sorted((plain(r) for r in df.select(names).collect()), key=str)
    assert got and got == sorted((plain(r) for r in q.fetchall()), key=str)
