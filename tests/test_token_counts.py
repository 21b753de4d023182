"""Tokens are counted within the row (F21, F22); scoring writes its posts once."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from murmur.operators import tfidf as TF
from murmur.plans import catalog
from murmur.sources import tables as TB

ROWS = [(1, "b bb bb ccc AAA aaa"), (2, None), (3, ""), (4, "x"), (5, "人工智能 aaa"), (5, "aaa ccc"), (None, "ccc ddd"),
        (None, "ccc"), (6, "zz yy xx ww vv uu zz yy")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _want():
    want = Counter()
    for i, text in ROWS:
        for w in (text or "").lower().split():
            if w == "人工智能":
                want.update([(i, "人工"), (i, "工智"), (i, "智能")])
            elif len(w) > 1:
                want[(i, w)] += 1
    return want


def test_tokens_of_shared_and_null_ids(spark):
    posts = spark.createDataFrame(ROWS, "id long, content string").repartition(3)
    got = [((r.id, r.term), r.tf) for r in TF.post_tokens(posts, []).collect()]
    assert sorted(got, key=str) == sorted(_want().items(), key=str)
    lists = {}
    for (i, w), n in _want().items():
        lists.setdefault(i, []).append((-n, w))
    top = sorted(((i, k, w) for i, ws in lists.items() for k, (_, w) in enumerate(sorted(ws)[:3], 1)), key=str)
    assert sorted(((r.id, r["rank"], r.term) for r in TF.post_keywords(posts, 3, []).collect()), key=str) == top


@pytest.mark.parametrize("count", [TF.post_tokens, TF.post_keywords])
def test_no_aggregate_or_sort_holds_the_tokens_of_a_task(spark, count):
    posts = spark.createDataFrame([(1, "aaa bbb aaa"), (2, "ccc")], "id long, content string")
    plan = _plan(count(posts))
    assert "Aggregate" not in plan and "Sort " not in plan and "Exchange" not in plan


def test_texts_take_part_in_one_join(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    tables = {"documents": ([(1, "a"), (2, "b"), (2, "bb"), (None, "n"), (3, None), (9, "z")], "doc_id long, text string"),
              "events": ([(5, t, 0, 1.0), (10, t, 1, 2.0), (10, t, 2, 3.0), (15, t, None, 1.0), (6, t, 1, 1.0), (45, t, 1, None), (None, t, 1, 1.0)],
                         "event_id long, ts timestamp, user_id long, value double"),
              "labels": ([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int"),
              "nation": ([(0, "A"), (1, "B"), (2, "C")], "n_nationkey int, n_name string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    posts = TB.posts_doc(spark, str(tmp_path))
    got = sorted((tuple(r) for r in posts.select("id", "content", "author", "sentiment", "analyze_status").collect()), key=str)
    assert got == sorted([(1, "a", "user0", 1, 1), (1, "a", "user0", 0, 1), (2, "b", "user1", None, 0), (2, "b", "user2", None, 0),
                          (2, "bb", "user1", None, 0), (2, "bb", "user2", None, 0), (9, "z", "user1", None, 0)], key=str)
    lines = posts._jdf.queryExecution().optimizedPlan().toString().split("\n")
    scan = next(x for x in lines if "text#" in x and "Relation" in x)
    above = [x for x in lines[:lines.index(scan)] if "Join" in x and x.index("Join") < scan.index("Relation")]
    assert len(above) == 1


@pytest.mark.parametrize("name", ["score_posts", "analyze_batch"])
def test_scoring_joins_its_posts_once(spark, sf_small, monkeypatch, name):
    made, real = [], TB.posts_doc
    monkeypatch.setattr(TB, "posts_doc", lambda *a: made.append(1) or real(*a))
    rows = catalog.QUERIES[name](spark, sf_small)
    assert len(made) == 1 and rows.agg(F.count(F.lit(1))).first()[0] > 0
