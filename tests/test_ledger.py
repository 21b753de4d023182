"""Link ledger over repeated runs, and rolling sums."""
import datetime as dt
import random

from pyspark.sql import functions as F

from murmur.operators import ledger as LG
from murmur.operators.rolling import rolling_sums
from murmur.plans import clustering as PL

T0 = dt.datetime(2024, 1, 1)


def test_ledger_counts_every_linked_post_once(spark):
    r = random.Random(4)
    ledger, folded, now = spark.createDataFrame([], LG.SCHEMA), spark.createDataFrame([], LG.SCHEMA), {}
    for run in range(4):
        links = [(i, r.choice([1, 2, 3, 2**40]), r.choice([0, 1, None]), r.choice([None, 5, 70])) for i in r.sample(range(60), 40)]
        now.update({x[0]: x[1:] for x in links})
        df = spark.createDataFrame(links, "id long, topic_id long, sentiment int, likes int")
        ledger = ledger.unionByName(LG.link_changes(ledger, df, run))
        folded = LG.fold(folded.unionByName(LG.link_changes(folded, df, run)))
    for table in (ledger, folded):
        got = {x.topic_id: (x.post_count, round(x.sentiment_ratio, 9), round(x.heat_score, 9)) for x in LG.topic_totals(table).collect()}
        want = {}
        for t in {v[0] for v in now.values()}:
            own = [v for v in now.values() if v[0] == t]
            n, pos, likes = len(own), sum(v[1] == 1 for v in own), sum(v[2] or 0 for v in own)
            want[t] = (n, round(pos / n, 9), round(n * (1 + likes / n / 100), 9))
        assert got == want
    assert folded.count() == len(now)


def test_same_links_again_add_no_rows(spark):
    df = spark.createDataFrame([(1, 5, 1, 3), (2, 5, None, None)], "id long, topic_id long, sentiment int, likes int")
    first = LG.link_changes(spark.createDataFrame([], LG.SCHEMA), df, 0)
    assert first.count() == 2 and LG.link_changes(first, df, 1).count() == 0
    moved = LG.link_changes(first, df.limit(1).withColumn("topic_id", F.lit(6).cast("long")), 2).collect()
    assert sorted((x.id, x.topic_id, x.d) for x in moved) == [(1, 5, -1), (1, 6, 1)]


def test_hourly_runs_count_repeated_posts_once(spark):
    """Three runs over overlapping windows of the same groups of posts."""
    words = {0: "alpha beta gamma delta epsilon", 1: "red green blue yellow violet", 2: "north south east west centre"}
    posts = [(i, f"{words[i % 3]} {words[i % 3].split()[i % 5]}", i % 2, i, T0 + dt.timedelta(hours=i)) for i in range(36)]
    df = spark.createDataFrame(posts, "id long, content string, sentiment int, likes int, crawl_time timestamp_ntz")
    topics = spark.createDataFrame([], "id long, topic_name string, keywords string, keyword_list array<string>, post_count long, "
                                       "sentiment_ratio double, heat_score double, first_seen timestamp_ntz, last_updated timestamp_ntz, status string")
    ledger, seen = spark.createDataFrame([], LG.SCHEMA), set()
    for run, (a, b) in enumerate([(0, 24), (6, 30), (12, 36)]):
        own = df.filter((F.col("id") >= a) & (F.col("id") < b))
        out = PL.hourly_run(own, topics, ledger, T0 + dt.timedelta(hours=b), run, eps=0.4, min_samples=3)
        topics, ledger = out.topics, out.ledger
        seen |= set(range(a, b))
        assert sum(x.post_count for x in topics.collect()) == ledger.count() <= len(seen)
    rows = topics.collect()
    assert len(rows) == 3 and sorted(x.post_count for x in rows) == [12, 12, 12]
    assert all(abs(x.sentiment_ratio - 0.5) < 1e-9 for x in rows)


def brute_rolling(per, window):
    out = {}
    for m, a, b in per:
        for k in range(window):
            x = out.setdefault(m + dt.timedelta(minutes=k), [0, 0])
            x[0] += a
            x[1] += b
    return {m: tuple(v) for m, v in out.items()}


def test_rolling_sums_over_blocks(spark):
    r = random.Random(2)
    per = [(T0 + dt.timedelta(minutes=m), r.randint(1, 9), r.randint(0, 4)) for m in sorted(r.sample(range(4000), 150))]
    df = spark.createDataFrame(per, "minute timestamp_ntz, total long, negative long")
    for window, block in ((1, 7), (60, 100), (60, 10_080), (1440, 33)):
        got = {x.minute: (x.total, x.negative) for x in rolling_sums(df, window, block).collect()}
        assert got == brute_rolling(per, window)
    assert rolling_sums(df.limit(0), 60).count() == 0
