"""Optional conditions of the rules, exact metrics, waiting posts of the scoring stream."""
import datetime as dt
import random

import pytest

from murmur.operators import alerts as AL
from murmur.operators import reports as R
from murmur.operators import score as SC
from murmur.operators import topics as TP
from murmur.sources.tables import rules_table
from murmur.streaming import streams as ST
from test_units import _feed, _files

NOW = dt.datetime(2024, 1, 10, 12)


@pytest.mark.parametrize("threshold,fires", [(None, True), (0.3, True), (0.5, True), (0.51, False)])
def test_surge_baseline(spark, threshold, fires):
    """Now 8 of 10 negative, before 3 of 10: a rise of 0.5."""
    rows = [(i, 0 if i < 8 else 1, NOW - dt.timedelta(minutes=30)) for i in range(10)]
    rows += [(20 + i, 0 if i < 3 else 1, NOW - dt.timedelta(hours=3)) for i in range(10)]
    rows += [(40 + i, 0, NOW - dt.timedelta(hours=20)) for i in range(50)]      # before the baseline
    posts = spark.createDataFrame(rows, "id long, sentiment int, crawl_time timestamp_ntz")
    got = AL.negative_surge(posts, NOW, 0.6, 5, 1, 6, threshold).collect()
    assert [(r.total_posts, r.negative_posts) for r in got] == ([(10, 8)] if fires else [])
    quiet = posts.filter("id < 20")
    assert AL.negative_surge(quiet, NOW, 0.6, 5, 1, 6, 0.0).count() == 0      # nothing to exceed
    assert AL.negative_surge(quiet, NOW, 0.6, 5, 1).count() == 1


def test_rules_apply_their_baseline_on_request(spark):
    config = '{"negativeRatioThreshold": 0.6, "minPostCount": 2, "windowHours": 1, "baselineHours": 6, "baselineThreshold": 0.3, "silenceHours": 1}'
    rules = rules_table(spark, [(1, "s", "negative_surge", config, True)])
    posts = spark.createDataFrame([(i, 0, NOW - dt.timedelta(hours=3 * (i // 5), minutes=10), "weibo", "x", None) for i in range(10)],
                                  "id long, sentiment int, crawl_time timestamp_ntz, platform string, content string, topic_id long")
    topics = spark.createDataFrame([], "id long, topic_name string, status string, first_seen timestamp_ntz, last_updated timestamp_ntz")
    run = lambda **o: AL.evaluate_rules(posts, topics, rules, None, NOW, **o).count()
    assert (run(), run(baseline=True)) == (1, 0)


def test_growth_against_an_equal_window(spark):
    hours = [1] * 6 + [30] * 5 + [100] * 40
    posts = spark.createDataFrame([(i, 1, NOW - dt.timedelta(hours=h)) for i, h in enumerate(hours)], "id long, topic_id long, crawl_time timestamp_ntz")
    topics = spark.createDataFrame([(1, "t", "active", NOW, NOW)], "id long, topic_name string, status string, first_seen timestamp_ntz, last_updated timestamp_ntz")
    got = [R.topic_growth(topics, posts, 24, NOW, equal_window=e).first() for e in (False, True)]
    assert [(r.current_count, r.previous_count) for r in got] == [(6, 45), (6, 5)]


def test_heat_decay(spark):
    m = spark.createDataFrame([(1, 1, 100, NOW - dt.timedelta(hours=12)), (1, 0, None, NOW - dt.timedelta(hours=48)), (2, 1, 0, NOW + dt.timedelta(hours=1)), (3, 1, 0, None)],
                              "label long, sentiment int, likes int, crawl_time timestamp_ntz")
    got = {r.label: r.heat_score for r in TP.topic_metrics(m, "label", NOW, 6.0).collect()}
    assert got == {1: 3.0 / 4, 2: 1.0, 3: 1.0}
    assert {r.label: r.heat_score for r in TP.topic_metrics(m).collect()} == {1: 3.0, 2: 1.0, 3: 1.0}


def test_exact_metrics(spark):
    r = random.Random(6)
    rows = [(r.randint(0, 1), r.choice([0.0, 1.0, r.random(), 0.5, 0.5001]), r.randint(0, 1)) for _ in range(500)]
    got = SC.binary_metrics(spark.createDataFrame(rows, "label int, score double, prediction int").repartition(5)).first()
    pos, neg = [s for y, s, _ in rows if y], [s for y, s, _ in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(got.auc - want) < 1e-12 and got.n_test == 500
    assert abs(got.accuracy - sum(y == c for y, _, c in rows) / 500) < 1e-12
    one = SC.binary_metrics(spark.createDataFrame(rows[:0] + [(1, 0.4, 1)], "label int, score double, prediction int")).first()
    assert one.auc is None and one.accuracy == 1.0


def _scorer():
    def half(texts):      # local: it travels to the tasks by value
        return [0.4] * len(texts), [0.6] * len(texts)

    return SC.function_scorer(half)


def test_scoring_waits_and_takes_the_oldest_first(spark, tmp_path):
    """Batches of 3, 3, 6 and, after a restart, 1: at least 4 posts, at most 5 at a time."""
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    post = lambda *ids: [(i, f"text {i}") for i in ids]
    score = _scorer()
    _files(spark, src + "/a", "id long, content string", [post(9, 3, 7), post(8, 1, 5), post(*range(20, 26))])
    run = lambda: ST.run_scoring(_feed(spark, src, "id long, content string"), score, out=out, checkpoint=ck, min_batch=4, limit=5)
    run()
    at = lambda: {e: sorted(r.id for r in spark.read.parquet(f"{out}/_epoch={e}").collect()) for e in ST._epochs(spark, out)}
    assert at() == {0: [], 1: [1, 3, 5, 7, 8], 2: [9, 20, 21, 22, 23]}
    _files(spark, src + "/b", "id long, content string", [post(30), post(31)])
    run()
    assert at()[3] == [] and at()[4] == [24, 25, 30, 31]
    assert spark.read.parquet(f"{out}-waiting/_epoch=4").count() == 0


def test_scoring_at_an_interval(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    _files(spark, src, "id long, content string", [[(1, "a")], [(2, "b")]])
    path, query = ST.run_scoring(_feed(spark, src, "id long, content string"), _scorer(), out=out, checkpoint=ck, every="1 second")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
