"""Every query with an oracle matches DuckDB on the smallest tables."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from murmur.sources.tables import TABLES

# the training-data operators have tests of their own in tests/llm
SQL = {k: v for k, v in E.oracle_sql().items() if k in E.catalog.QUERIES}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, sf_small, duck, name):
    df = E.queries()[name](spark, sf_small)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(SQL[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == _rows(cols, res.fetchall())


def test_every_query_has_callable_and_rows_only_are_few():
    q = E.catalog.QUERIES
    assert set(SQL) <= set(q)
    rows_only = set(q) - set(SQL)
    assert rows_only <= {"embedding_neighbours", "tokens_dictionary", "train_eval", "score_posts", "analyze_batch", "stream_score", "stream_heartbeats"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["hour", "total", "positive", "negative"]
    assert df.count() >= 0
