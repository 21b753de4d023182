"""Queries with SQL match DuckDB on the smallest tables."""
import duckdb
import pytest

from murmur.llm import queries as Q

TABLES = ["documents", "benchmark", "pages", "labels", "conversations"]


def _key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_duckdb(spark, sf_small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    res = con.execute(Q.ORACLE[name])
    names = [c[0] for c in res.description]
    want = sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in res.fetchall()), key=_key)
    df = Q.QUERIES[name](spark, sf_small)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*names).collect()), key=_key)
    assert got == want and got


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in Q.QUERIES) == list(range(1, 14))
