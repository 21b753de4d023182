"""Substring index and page directory."""
import datetime as dt
import random
import re

from pyspark.sql import functions as F

from murmur.operators import listing as L
from murmur.operators import textindex as TI


def made(spark, seed=1, n=150):
    r = random.Random(seed)
    rows = [(i * 37 % 5000, "".join(r.choice("aBé漢😀 ") for _ in range(r.randint(0, 60)))) for i in range(n)]
    rows += [(9000, None), (None, "aB"), (9001, "É x"), (9002, "abc" * 30_000 + "needle")]
    return rows, spark.createDataFrame(rows, "id long, content string").repartition(4)


def test_search_equals_contains(spark, tmp_path):
    rows, df = made(spark)
    index = TI.build_text_index(df, str(tmp_path / "x"), width=500, buckets=4)
    words = ["a", "AB", "é漢", "ab a", "漢😀b", "Needle", "É X", "", "  ", "zzz", "aaaaaa", "a" * 200]
    got = {(x.keyword, x.id) for x in TI.search_indexed(index, spark.createDataFrame([(w,) for w in words], "keyword string")).collect()}
    low = lambda t: t.lower()
    assert got == {(w, i) for w in words if w.strip() for i, t in rows if i is not None and t and low(w) in low(t)}
    assert ("Needle", 9002) in got


def test_search_reads_the_blocks_of_candidates_only(spark, tmp_path):
    rows = [(i, f"post number {i} of many" + (" rare" if i == 4321 else "")) for i in range(0, 6000, 3)] + [(4321, "something rare")]
    index = TI.build_text_index(spark.createDataFrame(rows, "id long, content string"), str(tmp_path / "x"), width=500, buckets=8)
    words = spark.createDataFrame([("RARE",)], "keyword string")
    assert [x.id for x in TI.candidates(index, TI.keyword_grams(words)).collect()] == [4321]
    out = TI.search_indexed(index, words)
    assert [x.id for x in out.collect()] == [4321]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*block#\d+ (IN \(8\)|= 8)", plan)
    assert all(len(x.ids) <= 500 for x in index.lists().collect())


def test_empty_index_and_no_keywords(spark, tmp_path):
    rows, df = made(spark, n=5)
    index = TI.build_text_index(df, str(tmp_path / "x"))
    assert TI.search_indexed(index, spark.createDataFrame([], "keyword string")).count() == 0


def test_every_page_starts_at_its_key(spark, monkeypatch):
    """Many posts of one hour, second and time, ids far apart, and no time at all."""
    r = random.Random(3)
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    times = [t0, t0, t0 + dt.timedelta(microseconds=7), t0 + dt.timedelta(seconds=1), t0 + dt.timedelta(hours=3), None]
    rows = [(i * 40_000 + r.randint(0, 9), r.choice(times), "text") for i in range(90)]
    df = spark.createDataFrame(rows, "id long, publish_time timestamp_ntz, content string").repartition(3)
    want = sorted(rows, key=lambda x: (x[1] is not None, x[1] or t0, x[0]), reverse=True)
    for small in (1, 1000):
        directory = L.hour_counts(df).cache()
        for skip in (0, 44, 89):
            assert L.key_at(df, skip, directory, small) == (want[skip][1], want[skip][0])
        assert L.key_at(df, 90, small=small) is None
    monkeypatch.setattr(L, "SORTED", 3)
    for page in (1, 5, 9, 10):
        got = [x.id for x in L.search_posts(df, page=page, size=10).collect()]
        assert got == [x[0] for x in want[(page - 1) * 10: page * 10]]
    assert [x.id for x in L.search_posts(df, keyword="TEXT", page=2, size=7, after=(want[9][1], want[9][0])).collect()] == [x[0] for x in want[17:24]]
