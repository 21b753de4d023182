"""Hand fixtures with values computed by hand (FIXTURES E)."""
import datetime as dt

from pyspark.sql import functions as F

from murmur.functions import parse as P
from murmur.functions import text as TX
from murmur.operators import alerts as AL
from murmur.operators import cluster as CL
from murmur.operators import notify as N
from murmur.operators import score as SC
from murmur.operators import topics as TP
from murmur.sources import ingest as I

AS_OF = dt.datetime(2024, 6, 20, 15, 0, 0)


def _col(spark, values, name="s", typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {typ}")


def test_parse_time(spark):
    vals = ["5分钟前", "2小时前", "今天 08:30", "今天", "今天12:30", "06-15 12:30",
            "06月15日 12:30", "2024-06-15 12:30", "garbage", None]
    df = _col(spark, vals).select(P.parse_time(F.col("s"), AS_OF).alias("t"),
                                  P.parse_time(F.col("s"), AS_OF, compat=True).alias("c"))
    got = [tuple(r) for r in df.collect()]
    d = dt.datetime
    assert [g[0] for g in got] == [
        d(2024, 6, 20, 14, 55), d(2024, 6, 20, 13, 0), d(2024, 6, 20, 8, 30), d(2024, 6, 20, 12, 0),
        d(2024, 6, 20, 12, 30), d(2024, 6, 15, 12, 30), d(2024, 6, 15, 12, 30), d(2024, 6, 15, 12, 30),
        AS_OF, AS_OF]
    # compat: no-space today -> 12:00, Chinese month-day -> now
    assert got[4][1] == d(2024, 6, 20, 12, 0)
    assert got[6][1] == AS_OF


def test_parse_count(spark):
    vals = [None, "", "赞", "12", "1,234", "1.2万", "1.13万"]
    df = _col(spark, vals).select(P.parse_count(F.col("s")).alias("b"),
                                  P.parse_count(F.col("s"), compat=True).alias("c"),
                                  P.parse_count_first_digits(F.col("s")).alias("a"))
    got = [tuple(r) for r in df.collect()]
    assert [g[0] for g in got] == [0, 0, 0, 12, 1234, 12000, 11300]
    assert got[6][1] == 11299
    assert got[5][2] == 1


def test_char_encode(spark):
    df = _col(spark, ["人工智能ab", "", "x" * 1501]).select(TX.char_encode(F.col("s")).alias("c"))
    a, b, c = [r.c for r in df.collect()]
    assert a[:6] == [236, 135, 340, 155, 99, 100] and len(a) == 1500 and set(a[6:]) == {0}
    assert b == [0] * 1500
    assert len(c) == 1500 and c[-1] == (ord("x") % 498) + 2


def test_tokenize_han_bigrams_and_stop_words(spark):
    df = _col(spark, ["我们的人工智能AI, and 新能源!"]).select(TX.tokenize(F.col("s")).alias("t"))
    toks = df.first().t
    assert "人工" in toks and "工智" in toks and "智能" in toks and "ai" in toks and "and" in toks
    assert "的" not in toks


def test_content_and_note_id(spark):
    import hashlib
    df = spark.createDataFrame([("作者", "内容 text", "https://x.com/explore/0123456789abcdef01234567?x=1"),
                                ("a", "b", "https://x.com/p/1")], "author string, text string, url string")
    r = df.select(I.content_id(F.col("author"), F.col("text")).alias("c"), I.note_id(F.col("url")).alias("n")).collect()
    assert r[0].c == "wb_" + hashlib.md5("weibo_作者_内容 text".encode()).hexdigest()
    assert r[0].n == "0123456789abcdef01234567"
    assert r[1].n == hashlib.md5(b"https://x.com/p/1").hexdigest()


def test_first_match_list_order_and_case(spark):
    df = _col(spark, ["跑路了 暴雷", "nothing", "Error"], "content")
    got = [r.matched_word for r in df.withColumn("id", F.lit(1))
           .select(AL.first_match(F.col("content"), ["暴雷", "跑路", "error"]).alias("matched_word")).collect()]
    assert got == ["暴雷", None, None]
    many = [f"w{i}" for i in range(100)] + ["跑路"]
    got2 = [r.m for r in df.select(AL.first_match(F.col("content"), many).alias("m")).collect()]
    assert got2 == ["跑路", None, None]


def test_silence_null_safe_and_compat(spark):
    t = dt.datetime(2024, 1, 2, 12)
    prior = spark.createDataFrame([("negative_surge", None, t - dt.timedelta(hours=23)),
                                   ("topic_growth", 7, t - dt.timedelta(hours=48)),
                                   ("topic_growth", 8, t - dt.timedelta(hours=49))],
                                  "alert_type string, related_topic_id long, created_at timestamp_ntz")
    cand = spark.createDataFrame([(1, "negative_surge", None, t), (2, "topic_growth", 7, t),
                                  (3, "topic_growth", 8, t), (4, "topic_growth", 9, t)],
                                 "id long, alert_type string, related_topic_id long, created_at timestamp_ntz")
    hrs = {"negative_surge": 24, "topic_growth": 48}
    s = {r.id: r.suppressed for r in AL.silence(cand, prior, hrs).collect()}
    assert s == {1: True, 2: True, 3: False, 4: False}
    c = {r.id: r.suppressed for r in AL.silence(cand, prior, hrs, null_safe=False).collect()}
    assert c[1] is False


def _graph(spark, n, edges, mult=None, zero=()):
    texts = spark.createDataFrame([(i, (mult or {}).get(i, 1)) for i in range(1, n + 1)], "uid long, mult long")
    nz = spark.createDataFrame([(i,) for i in range(1, n + 1) if i not in zero], "uid long")
    pairs = spark.createDataFrame(edges, "i long, j long")
    return texts, nz, pairs


def test_chain_ball_differs_from_density(spark):
    # 1-2-3 chain, min_samples 2: density joins all three, ball makes 1 a
    # centre (claims 2), 3 is a centre of its own (its only neighbour 2 is not a centre).
    texts, nz, pairs = _graph(spark, 4, [(1, 2), (2, 3)], zero=(4,))
    db = {r.uid: r.label for r in CL.dbscan(texts, nz, pairs, 2).collect()}
    ld = {r.uid: r.label for r in CL.leader(texts, nz, pairs, 2).collect()}
    assert db == {1: 1, 2: 1, 3: 1}
    assert ld == {1: 1, 2: 1, 3: 3}


def test_duplicates_count_in_degree_and_zero_vector(spark):
    texts, nz, pairs = _graph(spark, 3, [(1, 2)], mult={1: 3}, zero=(3,))
    deg = {r.uid: r.degree for r in CL.degrees(texts, nz, pairs).collect()}
    assert deg == {1: 4, 2: 4, 3: 0}


def test_lfmis_matches_sequential(spark):
    import random
    rnd = random.Random(7)
    n = 25
    edges = sorted({(a, b) for a, b in ((rnd.randint(1, n), rnd.randint(1, n)) for _ in range(40)) if a < b})
    nodes = spark.createDataFrame([(i,) for i in range(1, n + 1)], "uid long")
    e = spark.createDataFrame(edges + [(b, a) for a, b in edges], "src long, dst long")
    got = sorted(r.uid for r in CL.lfmis(nodes, e).collect())
    adj = {i: set() for i in range(1, n + 1)}
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    chosen = []
    for v in range(1, n + 1):
        if not adj[v] & set(chosen):
            chosen.append(v)
    assert got == chosen


def test_jaccard_and_merge(spark):
    cl = spark.createDataFrame([(10, ["a", "b", "c"], "a,b,c", "a/b/c", 4, 0.5, 10.0),
                                (20, ["x", "y"], "x,y", "x/y", 2, 1.0, 3.0),
                                (30, ["x", "y", "z"], "x,y,z", "x/y/z", 3, 0.0, 5.0)],
                               "label long, keyword_list array<string>, keywords string, topic_name string, "
                               "post_count long, sentiment_ratio double, heat_score double")
    t0 = dt.datetime(2024, 1, 1)
    topics = spark.createDataFrame([(1, "a/b", "a,b,c", ["a", "b", "c"], 6, 0.25, 12.0, t0, t0, "active")],
                                   "id long, topic_name string, keywords string, keyword_list array<string>, "
                                   "post_count long, sentiment_ratio double, heat_score double, "
                                   "first_seen timestamp_ntz, last_updated timestamp_ntz, status string")
    merged, assign = TP.merge_topics(cl, topics, dt.datetime(2024, 1, 2), threshold=0.6)
    a = {r.label: r.topic_id for r in assign.collect()}
    assert a[10] == 1 and a[20] == a[30] == 2 + 20
    m = {r.id: r for r in merged.collect()}
    assert m[1].post_count == 10 and abs(m[1].sentiment_ratio - (0.25 * 6 + 0.5 * 4) / 10) < 1e-12
    assert m[1].heat_score == 12.0
    assert m[22].post_count == 5 and abs(m[22].sentiment_ratio - 2 / 5) < 1e-12


def test_decide_tie_is_negative(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.2, 0.8), (0.9, 0.1)], "n double, p double")
    r = [tuple(x) for x in df.select(SC.decide(F.col("n"), F.col("p")).alias("d")).select("d.*").collect()]
    assert [x[0] for x in r] == [0, 1, 0]


def test_upsert_config(spark):
    tbl = spark.createDataFrame([("AI", "all", True), ("就业", "all", True)], "keyword string, platform string, enabled boolean")
    ch = spark.createDataFrame([("insert", "新词", "weibo", True), ("update", "AI", "all", False),
                                ("delete", "就业", "all", None), ("insert", "AI", "all", True)],
                               "op string, keyword string, platform string, enabled boolean")
    out = {(r.keyword, r.platform): r.enabled for r in AL.upsert_config(tbl, ch, ["keyword", "platform"]).collect()}
    assert out == {("AI", "all"): False, ("新词", "weibo"): True}


def test_ingest_idempotent(spark):
    ex = spark.createDataFrame([("weibo", "a", "x", 1, dt.datetime(2024, 1, 1))],
                               "platform string, post_id string, author string, likes int, crawl_time timestamp_ntz")
    inc = spark.createDataFrame([("weibo", "a", "y", 5, dt.datetime(2024, 1, 2)),
                                 ("weibo", "b", "z", 2, dt.datetime(2024, 1, 2)),
                                 ("weibo", "b", "w", 3, dt.datetime(2024, 1, 3))], ex.schema)
    once = I.ingest_ignore(ex, inc)
    twice = I.ingest_ignore(once, inc)
    rows = sorted(tuple(r) for r in twice.select("post_id", "author", "likes").collect())
    assert rows == [("a", "x", 1), ("b", "z", 2)]
    up = sorted(tuple(r) for r in I.ingest_upsert(ex, inc).select("post_id", "author", "likes").collect())
    assert up == [("a", "x", 5), ("b", "z", 3)]


def test_outbox_routing(spark):
    t = dt.datetime(2024, 1, 2, 3, 4, 5, 123000)
    al = spark.createDataFrame([(1, "negative_surge", "critical", "T", "D", t),
                                (2, "topic_growth", "warning", "T", "D", t),
                                (3, "keyword_trigger", "info", "T", "D", t)],
                               "id long, alert_type string, severity string, title string, description string, "
                               "created_at timestamp_ntz")
    out = sorted((r.alert_id, r.channel) for r in N.notification_outbox(al).collect())
    assert out == [(1, "email"), (1, "webhook"), (2, "webhook")]
    txt = al.select(N.iso_time_text(F.col("created_at")).alias("x")).first().x
    assert txt == "2024-01-02T03:04:05.123"


def test_html_cards():
    from murmur.sources.html import ARTICLES, SEARCH_CARDS, parse_cards
    page = ('<html><body><nav><a href="/x">menu</a></nav><article><h1>T &amp; U</h1>'
            '<p>Hello <b>world</b> &amp; more<br><p>second</p></article>'
            '<article><h1></h1></article></body></html>')
    cards = parse_cards(page, ARTICLES)
    assert len(cards) == 1 and cards[0]["title"] == "T & U"
    assert cards[0]["text"] == "Hello world & more second"
    act = ('<div class="card-act"><ul><li>a</li><li><a>转发 3</a></li><li><a>评论 1,234</a></li><li><a>1.2万</a></li></ul></div>')
    search = ('<div class="card-wrap"><div class="menu"><ul><li>举报</li></ul></div><div class="content"><a class="name">作者</a>'
              '<p class="txt">内容 <em>一</em></p><p class="from"><a>5分钟前</a> 来自 <a>iPhone 13</a></p></div>' + act + '</div>'
              '<div class="card-wrap"><div class="content"><a class="name">x</a></div></div>'
              '<div class="card-wrap"><div class="content"><a nick-name="n">别名</a><p class="txt">login-container 也行</p></div></div>')
    c = parse_cards(search, SEARCH_CARDS)
    assert len(c) == 2 and c[0]["author"] == "作者" and c[0]["text"] == "内容 一"
    assert c[0]["time"] == "5分钟前" and c[0]["likes_text"] == "1.2万" and c[0]["comments"] == "评论 1,234"
    assert c[1]["author"] == "别名" and c[1]["time"] is None and c[1]["shares"] is None


def test_note_cards(spark):
    from murmur.sources.html import NOTE_CARDS, extract_posts, parse_cards
    note = ('<section class="note-item"><a href="%s"><span class="title">标题</span></a><div class="author"><i class="name">某人</i></div>'
            '<div class="like-wrapper"><b class="count">1.5万</b></div></section>')
    page = (note % "/explore/0123456789abcdef01234567?x=1" + note.replace('href="%s"', 'rel="x"')
            + note % "https://h.example/discovery/item/7")
    cards = parse_cards(page, NOTE_CARDS)
    assert [c["link"] for c in cards] == ["https://www.xiaohongshu.com/explore/0123456789abcdef01234567?x=1",
                                          "https://h.example/discovery/item/7"]      # a card without a link is skipped
    assert parse_cards('<div class="login-container"></div>' + page, NOTE_CARDS) == []
    r = extract_posts(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), AS_OF, NOTE_CARDS).collect()
    assert r[0].post_id == "xhs_0123456789abcdef01234567" and r[0].likes == 15000 and r[0].content == "标题"
    assert r[0].author == "某人" and r[0].platform == "xiaohongshu" and r[1].post_id.startswith("xhs_")


def test_extract_posts_job(spark):
    from murmur.sources.html import SEARCH_CARDS, extract_posts
    html = ('<div class="card-wrap"><div class="content"><p class="txt">好 帖子</p>'
            '<p class="from"><a>今天 08:30</a></p></div><div class="card-act"><ul><li>a</li>'
            '<li>3</li><li>1,234</li><li>1.13万</li></ul></div></div>')
    pages = spark.createDataFrame([(1, "http://s/1", html)], "page_id long, url string, html string")
    r = extract_posts(pages, AS_OF, SEARCH_CARDS).first()
    assert r.author == "未知用户" and r.likes == 11300 and r.comments == 1234 and r.shares == 3
    assert r.publish_time == dt.datetime(2024, 6, 20, 8, 30) and r.post_id.startswith("wb_")


def test_notified_flags_and_rule_config(spark):
    al = spark.createDataFrame([(1, False), (2, False), (3, True)], "id long, notified boolean")
    dl = spark.createDataFrame([(1, "email", False), (1, "webhook", True), (2, "webhook", False)],
                               "alert_id long, channel string, ok boolean")
    got = {r.alert_id: r.notified for r in N.notified_flags(al, dl).collect()}
    assert got == {1: True, 2: False, 3: True}
    from murmur.sources.tables import rules_table
    r = {x.rule_type: x for x in AL.parse_rules(rules_table(spark)).collect()}
    assert r["negative_surge"].negative_surge.minPostCount == 20
    assert r["keyword_trigger"].keyword_trigger.sensitiveWords == ["暴雷", "跑路", "诈骗", "维权"]
    assert r["topic_growth"].topic_growth.growthRateThreshold == 3.0


def test_score_with_user_function(spark):
    import numpy as np
    posts = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "meh")], "id long, content string")

    def scorer(texts):
        if (texts == "bad").any():
            raise RuntimeError("cannot read it")
        pos = np.where(texts == "good", 0.9, 0.5)
        return 1 - pos, pos
    got = {r.id: (r.sentiment, r.analyze_status, r.error) for r in SC.function_scorer(scorer)(posts.coalesce(1)).collect()}
    assert got == {1: (1, 1, None), 2: (None, 2, "RuntimeError: cannot read it"), 3: (0, 1, None)}


def test_classifier_learns_han_text(spark):
    """Clauses without spaces: the classifier sees their bigrams."""
    good, bad = ["今天体验非常好", "服务非常好推荐", "质量非常好喜欢"], ["今天体验非常差", "服务非常差投诉", "质量非常差退货"]
    rows = [(i, t, int(t in good)) for i, t in enumerate((good + bad) * 5)]
    train = spark.createDataFrame(rows, "id long, content string, label int")
    new = spark.createDataFrame([(1, "环境非常好"), (2, "环境非常差")], "id long, content string")
    assert {r.id: r.sentiment for r in SC.score_posts(new, SC.train(train)).collect()} == {1: 1, 2: 0}


def test_analyse_batch_takes_the_oldest_pending(spark):
    rows = [(i, f"text number {i}", 0 if i % 2 else 1, None if i % 2 else 1) for i in range(8)]
    posts = spark.createDataFrame(rows, "id long, content string, analyze_status int, sentiment int")

    def score(p):
        return p.select("id", F.lit(0).alias("sentiment"), F.lit(0.5).cast("float").alias("sentiment_score"),
                        F.lit(1).alias("analyze_status"), F.lit(None).cast("string").alias("error"))
    out = {r.id: (r.analyze_status, r.sentiment, r.keywords) for r in SC.analyze_batch(posts, score, limit=2).collect()}
    assert len(out) == 8 and out[1][:2] == (1, 0) and out[3][:2] == (1, 0) and out[5][:2] == (0, None)
    assert out[0] == (1, 1, None) and "number" in out[1][2]


def test_partition_count_invariance(spark, sf_small):
    import __spark_entry__ as E
    q = E.queries()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    out = {}
    try:
        for n in ("3", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out[n] = {k: sorted(tuple(r) for r in q[k](spark, sf_small).collect())
                      for k in ("similar_pairs", "dbscan_clusters_wide", "leader_clusters_wide",
                                "sentiment_trend", "ingest_upsert")}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out["3"] == out["13"]


def test_write_feed_trend_json_mark_read(spark, tmp_path):
    from murmur.operators import listing as L
    posts = spark.createDataFrame(
        [(1, "weibo", 1, dt.datetime(2024, 1, 1, 10, 5), 3), (2, "xiaohongshu", 0, dt.datetime(2024, 1, 2, 11, 0), 3),
         (3, "weibo", 0, dt.datetime(2024, 1, 2, 11, 30), 3)],
        "id long, platform string, sentiment int, crawl_time timestamp_ntz, topic_id long")
    out = str(tmp_path / "posts")
    I.write_posts(posts, out)
    back = spark.read.parquet(out)
    assert sorted(str(r.crawl_date) for r in back.select("crawl_date").distinct().collect()) == ["2024-01-01", "2024-01-02"]
    assert [r.id for r in L.feed_filter(posts, "weibo", 0).collect()] == [3]
    tr = TP.topic_trend(posts, entries=1)
    assert [(r.hour, r.ratio) for r in tr.collect()] == [("2024-01-02 11:00:00", 0.0)]
    js = TP.trend_json(TP.topic_trend(posts)).first().sentiment_trend
    assert js == '{"2024-01-01 10:00:00":1.0,"2024-01-02 11:00:00":0.0}'
    al = spark.createDataFrame([(1, False), (2, False)], "id long, is_read boolean")
    assert {r.id: r.is_read for r in L.mark_read(al, 2).collect()} == {1: False, 2: True}


def _post_level(seed):
    """Random texts (some copied, some zero vectors), posts with shuffled ids,
    and the post-level neighbour relation (self and copies included)."""
    import random
    rnd = random.Random(seed)
    n_texts = 14
    mult = {t: (3 if rnd.random() < 0.2 else 1) for t in range(n_texts)}
    zero = {t for t in range(n_texts) if rnd.random() < 0.1}
    edges = {(a, b) for a in range(n_texts) for b in range(a + 1, n_texts)
             if rnd.random() < 0.18 and a not in zero and b not in zero}
    ids = list(range(100, 100 + sum(mult.values())))
    rnd.shuffle(ids)
    posts, k = {}, 0
    for t in range(n_texts):
        for _ in range(mult[t]):
            posts[ids[k]] = t
            k += 1

    def nbrs(p):
        t = posts[p]
        if t in zero:
            return []
        return [q for q, u in posts.items() if u == t or (min(t, u), max(t, u)) in edges]
    return posts, mult, zero, edges, nbrs


def _ball_reference(posts, nbrs, min_samples):
    """The original per-post loop (label -1 = unvisited and noise; the
    expansion never runs)."""
    labels = {p: -1 for p in posts}
    cid = 0
    for p in sorted(posts):
        if labels[p] != -1:
            continue
        nb = nbrs(p)
        if len(nb) < min_samples:
            continue
        labels[p] = cid
        for q in nb:
            if labels[q] == -1:
                labels[q] = cid
        cid += 1
    return labels


def _groups(labels):
    g = {}
    for p, lab in labels.items():
        if lab is not None and lab != -1:
            g.setdefault(lab, set()).add(p)
    return sorted(sorted(s) for s in g.values())


def test_leader_and_dbscan_match_post_level_definitions(spark):
    for seed in (1, 2, 3):
        posts, mult, zero, edges, nbrs = _post_level(seed)
        uid = {t: min(p for p, u in posts.items() if u == t) for t in mult}
        texts = spark.createDataFrame([(uid[t], mult[t]) for t in mult], "uid long, mult long")
        nz = spark.createDataFrame([(uid[t],) for t in mult if t not in zero], "uid long")
        pairs = spark.createDataFrame([(min(uid[a], uid[b]), max(uid[a], uid[b])) for a, b in edges] or
                                      [(-1, -2)], "i long, j long").filter("i >= 0")
        members = spark.createDataFrame([(p, uid[t]) for p, t in posts.items()], "id long, uid long")
        for min_samples in (2, 4):
            ld = {r.id: r.label for r in CL.labels_to_posts(CL.leader(texts, nz, pairs, min_samples), members).collect()}
            ref = _ball_reference(posts, nbrs, min_samples)
            assert _groups(ld) == _groups(ref), (seed, min_samples)
            # density: core posts connected through core neighbours; a border
            # post joins the smallest component among its core neighbours
            core = {p for p in posts if len(nbrs(p)) >= min_samples}
            comp = {}
            for p in sorted(core):
                if p in comp:
                    continue
                stack, seen = [p], {p}
                while stack:
                    x = stack.pop()
                    for y in nbrs(x):
                        if y in core and y not in seen:
                            seen.add(y)
                            stack.append(y)
                for x in seen:
                    comp[x] = min(seen)
            dens = dict(comp)
            for p in posts:
                if p not in core:
                    adj = [comp[q] for q in nbrs(p) if q in core]
                    if adj:
                        dens[p] = min(adj)
            db = {r.id: r.label for r in CL.labels_to_posts(CL.dbscan(texts, nz, pairs, min_samples), members).collect()}
            assert db == dens, (seed, min_samples)


import pytest  # noqa: E402


@pytest.mark.parametrize("seed", [5, 11, 23])
def test_similarity_join_exact_against_brute_force(spark, seed):
    import numpy as np
    from murmur.operators import similarity as SIM
    rng = np.random.default_rng(seed)
    n, m = 70, 30
    dense = np.where(rng.random((n, m)) < 0.25, rng.normal(0.8, 0.7, (n, m)), 0.0)
    dense[3] = dense[4]                      # an exact copy
    dense[7] = 0.0                           # a zero vector
    dense[8] = dense[9] * 2.5                # same direction
    rows = [(i, f"t{k}", float(dense[i, k])) for i in range(n) for k in range(m) if dense[i, k] != 0.0]
    vocab = spark.createDataFrame([(f"t{k}", int(rng.integers(1, 50))) for k in range(m)], "term string, df long")
    weights = spark.createDataFrame(rows, "uid long, term string, weight double").join(vocab, "term")
    norms = np.linalg.norm(dense, axis=1)
    unit = np.divide(dense, norms[:, None], out=np.zeros_like(dense), where=norms[:, None] > 0)
    cos = unit @ unit.T
    for t in (0.1, 0.3, 0.6, 0.9, 0.95):
        got = {(r.i, r.j) for r in SIM.similar_pairs(weights, t).collect()}
        want = {(i, j) for i in range(n) for j in range(i + 1, n)
                if norms[i] > 0 and norms[j] > 0 and cos[i, j] >= t - 1e-9}
        assert got == want, t


def test_monitored_posts_many_and_blank_keywords(spark, sf_small):
    from murmur.sources import tables as TB
    posts = TB.posts_event(spark, sf_small)
    rows = [("purchase", "all", True), ("Error", "weibo", True), ('"k": 1', "xiaohongshu", True), ("", "all", True),
            ("  ", "all", True), ("view", "all", False), ("人工智能", "all", True)] + [(f'"k": {i}', "all", True) for i in range(70)]
    got = sorted(tuple(r) for r in AL.monitored_posts(posts, TB.keywords_table(spark, rows)).collect())
    want = {}
    for p in posts.select("platform", "content").collect():
        for k, where, on in rows:
            if on and k.strip() and where in ("all", p.platform) and k.lower() in p.content.lower():
                want[(k, p.platform)] = want.get((k, p.platform), 0) + 1
    assert got == sorted((*k, n) for k, n in want.items()) and len(got) > 10
    assert [r.m for r in posts.limit(1).select(AL.first_match(F.col("content"), ["", " "]).alias("m")).collect()] == [None]


def test_keyset_pages_follow_each_other(spark):
    from murmur.operators import listing as L
    t = dt.datetime(2024, 1, 1)
    posts = spark.createDataFrame([(i, t + dt.timedelta(hours=i // 4)) for i in range(23)], "id long, publish_time timestamp_ntz")
    want = sorted(range(23), key=lambda i: (i // 4, i), reverse=True)
    seen, after = [], None
    while page := L.search_posts(posts, size=5, after=after).collect():
        seen += [r.id for r in page]
        after = (page[-1].publish_time, page[-1].id)
    assert seen == want
    assert [r.id for r in L.search_posts(posts, page=3, size=5).collect()] == want[10:15]
    assert L.search_posts(posts, page=9, size=5).count() == 0


def _files(spark, folder, schema, batches):
    """One Parquet file per batch, arriving one after the other."""
    import time
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{k}")
        time.sleep(0.02)


def _feed(spark, folder, schema):
    return (spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder))


def test_stream_dedup_late_post_and_restart(spark, tmp_path):
    """A late post is kept, a duplicate after 30 hours is not, and a second call
    with the same folders goes on where the first stopped."""
    from murmur.streaming import streams as ST
    t0 = dt.datetime(2024, 1, 1, 10)
    schema = "platform string, post_id string, likes int, crawl_time timestamp_ntz"
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    row = lambda p, h, n: ("weibo", p, n, t0 + dt.timedelta(hours=h))      # noqa: E731
    _files(spark, src + "/first", schema, [[row("a", 0, 1), row("b", 9, 1)], [row("late", -50, 1), row("a", 30, 2)]])
    ST.run_dedup(_feed(spark, src, schema), out, ck)
    _files(spark, src + "/second", schema, [[row("b", 60, 3), row("c", 61, 1)], [row("c", 62, 2)]])
    ST.run_dedup(_feed(spark, src, schema), out, ck)
    got = sorted((r.post_id, r.likes) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1), ("b", 1), ("c", 1), ("late", 1)]
    assert ST._epochs(spark, out) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        ST.run_dedup(_feed(spark, src, schema), out)


def test_stream_counts_keep_late_rows(spark, tmp_path):
    from murmur.streaming import streams as ST
    schema = "publish_time timestamp_ntz, sentiment int"
    t0 = dt.datetime(2024, 1, 5, 10)
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    _files(spark, src + "/a", schema, [[(t0, 1), (t0 + dt.timedelta(days=2), 0)], [(t0, 0)]])
    ST.run_counts(ST.stream_trend(_feed(spark, src, schema), dt.datetime(2024, 1, 1)), "t", "hour", out, ck)
    _files(spark, src + "/b", schema, [[(t0, 0), (t0, None)]])
    ST.run_counts(ST.stream_trend(_feed(spark, src, schema), dt.datetime(2024, 1, 1)), "t", "hour", out, ck)
    got = {r.hour: (r.total, r.positive, r.negative) for r in ST.total_counts(spark, out, "hour").collect()}
    assert got == {"2024-01-05 10:00:00": (3, 1, 2), "2024-01-07 10:00:00": (1, 0, 1)}


def test_live_feed_across_epochs_and_restart(spark, tmp_path):
    from murmur.streaming import streams as ST
    schema = "id long, platform string, publish_time timestamp_ntz, sentiment int"
    rows = [(i, "weibo" if i % 3 else "x", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=(i * 37) % 101), i % 2) for i in range(30)]
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    _files(spark, src + "/a", schema, [rows[:10], rows[10:20]])
    ST.live_feed(_feed(spark, src, schema), 5, out=out, checkpoint=ck)
    _files(spark, src + "/b", schema, [rows[20:]])
    path = ST.live_feed(_feed(spark, src, schema), 5, out=out, checkpoint=ck)
    newest = lambda rs: sorted(r[0] for r in sorted(rs, key=lambda r: (r[2], r[0]), reverse=True)[:5])      # noqa: E731
    assert path.endswith("_epoch=2") and sorted(r.id for r in spark.read.parquet(path).collect()) == newest(rows)
    some = ST.live_feed(_feed(spark, src, schema), 5, platform="weibo", sentiment=1)
    assert sorted(r.id for r in spark.read.parquet(some).collect()) == newest([r for r in rows if r[1] == "weibo" and r[3] == 1])


def test_rules_silence_within_one_run(spark):
    from murmur.sources.tables import rules_table
    t = AS_OF - dt.timedelta(minutes=1)
    posts = spark.createDataFrame(
        [(5, "weibo", "跑路 了", t, 0, 1), (3, "weibo", "暴雷", t, 0, 1), (9, "weibo", "fine", t, 1, 1)],
        "id long, platform string, content string, crawl_time timestamp_ntz, sentiment int, topic_id long")
    topics = spark.createDataFrame([], "id long, topic_name string, status string, last_updated timestamp_ntz, "
                                       "first_seen timestamp_ntz")
    rules = rules_table(spark, [(2, "kw", "keyword_trigger", '{"sensitiveWords": ["暴雷", "跑路"], "silenceHours": 1}', True)])
    out = {r.source_id: r.suppressed for r in AL.evaluate_rules(posts, topics, rules, None, AS_OF).collect()}
    assert out == {3: False, 5: True}
    compat = {r.source_id: r.suppressed
              for r in AL.evaluate_rules(posts, topics, rules, None, AS_OF, null_safe=False).collect()}
    assert compat == {3: False, 5: False}


def test_two_rules_of_one_type_use_their_own_hours(spark):
    """An alert 5 hours old silences the rule of 24 hours, not the one of 1 hour;
    of two that may fire, the first rule's candidate does."""
    from murmur.sources.tables import rules_table
    t = AS_OF - dt.timedelta(minutes=1)
    posts = spark.createDataFrame([(i, "weibo", "x", t, 0, None) for i in range(10)],
                                  "id long, platform string, content string, crawl_time timestamp_ntz, sentiment int, topic_id long")
    topics = spark.createDataFrame([], "id long, topic_name string, status string, last_updated timestamp_ntz, "
                                       "first_seen timestamp_ntz")
    cfg = '{"negativeRatioThreshold": 0.5, "minPostCount": 5, "windowHours": %d, "silenceHours": %d}'
    rules = rules_table(spark, [(1, "a", "negative_surge", cfg % (1, 24), True), (2, "b", "negative_surge", cfg % (2, 1), True),
                                (3, "c", "negative_surge", cfg % (3, 1), True), (4, "d", "negative_surge", cfg % (3, 1), False)])
    prior = spark.createDataFrame([("negative_surge", None, AS_OF - dt.timedelta(hours=5))],
                                  "alert_type string, related_topic_id long, created_at timestamp_ntz")
    run = lambda p: {r.rule_id: r.suppressed for r in AL.evaluate_rules(posts, topics, rules, p, AS_OF).collect()}
    assert run(prior) == {1: True, 2: False, 3: True}
    assert run(None) == {1: False, 2: True, 3: True}


def test_replay_equals_a_walk_in_time_order(spark):
    import random
    rnd = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    hours = {"keyword_trigger": 1, "topic_growth": 48, "negative_surge": 0}
    rows = [(i, k, rnd.choice([None, 1]), t0 + dt.timedelta(minutes=rnd.choice([0, 15, 30, 60, 61]) * rnd.randint(0, 60)))
            for i, k in enumerate(rnd.choice(list(hours)) for _ in range(300))]
    hist = spark.createDataFrame(rows, "id long, alert_type string, related_topic_id long, created_at timestamp_ntz")

    def walk(rows, last):
        out = {}
        for i, k, topic, t in sorted(rows, key=lambda r: (r[3], r[0])):
            f = last.get((k, topic))
            out[i] = f is not None and t <= f + dt.timedelta(hours=hours[k])
            if not out[i]:
                last[(k, topic)] = t
        return out
    assert {r.id: r.suppressed for r in AL.replay(hist, hours).collect()} == walk(rows, {})
    seed = [("keyword_trigger", None, t0 + dt.timedelta(hours=20)), ("topic_growth", 1, t0 - dt.timedelta(hours=40))]
    df = spark.createDataFrame(seed, "alert_type string, related_topic_id long, last timestamp_ntz")
    assert ({r.id: r.suppressed for r in AL.replay(hist, hours, df).collect()}
            == walk(rows, {(k, topic): t for k, topic, t in seed}))


def test_silence_state_across_epochs(spark, tmp_path):
    """Alerts at 10:00, nothing in the next file, 10:30, then a later file after
    a restart: the answer is that of one replay over all."""
    from murmur.streaming import streams as ST
    t0 = dt.datetime(2024, 1, 1, 10, 0)
    at = lambda i, m: (i, "keyword_trigger", None, t0 + dt.timedelta(minutes=m))      # noqa: E731
    schema = "id long, alert_type string, related_topic_id long, created_at timestamp_ntz"
    first, second = [[at(7, 0), at(3, 0)], [], [at(9, 30)]], [[at(12, 120), at(11, 61), at(13, 130)]]
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    _files(spark, src + "/a", schema, first)
    ST.run_silenced_alerts(_feed(spark, src, schema), {"keyword_trigger": 1}, out, ck)
    _files(spark, src + "/b", schema, second)
    path, keys = ST.run_silenced_alerts(_feed(spark, src, schema), {"keyword_trigger": 1}, out, ck)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 11, 13]    # 7 ties with 3, 9 and 12 are silenced
    assert keys == 1


def test_silence_state_equals_replay_and_ends_with_its_timer(spark, tmp_path):
    """Many keys over several files: equal to one replay over all; a key whose
    silence is over leaves the state."""
    import random
    from murmur.operators import alerts as AL
    from murmur.streaming import streams as ST
    r = random.Random(9)
    t0 = dt.datetime(2024, 1, 1)
    hours = {"keyword_trigger": 1, "topic_growth": 48}
    rows = sorted([(i, r.choice(list(hours)), r.choice([None, 1, 2]), t0 + dt.timedelta(minutes=r.randrange(9000))) for i in range(600)],
                  key=lambda x: x[3])
    rows += [(900, "topic_growth", 7, t0 + dt.timedelta(days=30)), (901, "topic_growth", 7, t0 + dt.timedelta(days=31))]
    schema = "id long, alert_type string, related_topic_id long, created_at timestamp_ntz"
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    _files(spark, src, schema, [rows[:200], rows[200:450], rows[450:600], rows[600:]])
    path, keys = ST.run_silenced_alerts(_feed(spark, src, schema), hours, out, ck)
    got = {x.id for x in spark.read.parquet(path).collect()}
    want = {x.id for x in AL.replay(spark.createDataFrame(rows, schema), hours).collect() if not x.suppressed}
    assert got == want and 50 < len(want) < 500
    assert keys <= 2      # only the last key is still silent; the six before timed out


def test_stream_counts_fold_their_epochs(spark, tmp_path, monkeypatch):
    """Folding leaves the totals as they are and bounds the folders that are read."""
    from murmur.streaming import streams as ST
    monkeypatch.setattr(ST, "COMPACT", 2)
    schema = "publish_time timestamp_ntz, sentiment int"
    t0 = dt.datetime(2024, 1, 5, 10)
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    _files(spark, src, schema, [[(t0 + dt.timedelta(hours=k % 2), 1)] for k in range(5)])
    ST.run_counts(ST.stream_trend(_feed(spark, src, schema), dt.datetime(2024, 1, 1)), "t", "hour", out, ck)
    assert ST._epochs(spark, out + "/folded") == [1, 3]
    got = {x.hour: x.total for x in ST.total_counts(spark, out, "hour").collect()}
    assert got == {"2024-01-05 10:00:00": 3, "2024-01-05 11:00:00": 2}
    assert len({f.split("/_epoch=")[1][0] for f in ST._counts_until(spark, out).inputFiles()}) == 2


def test_posting_lists_far_longer_than_a_block(spark, monkeypatch):
    """One term in every text: its list is cut into pairs of blocks, same pairs."""
    import numpy as np
    from murmur.operators import similarity as SIM
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((120, 20)) < 0.3, rng.normal(1.0, 0.5, (120, 20)), 0.0)
    dense[:, 0] = 2.0
    weights = spark.createDataFrame([(i, f"t{k}", k + 1, float(dense[i, k])) for i in range(120) for k in range(20)
                                     if dense[i, k] != 0.0], "uid long, term string, df long, weight double")
    run = lambda: sorted((r.i, r.j, round(r.similarity, 9)) for r in SIM.similar_pairs(weights, 0.5).collect())
    whole = run()
    monkeypatch.setattr(SIM, "BLOCK", 10)
    nv = SIM.normalized(weights, 0.5)
    units = SIM.posting_units(nv).groupBy("t", "lo", "hi").count()
    assert units.agg(F.max("count")).first()[0] <= 40 and units.agg(F.max("hi")).first()[0] >= 11
    assert run() == whole and len(whole) > 100


def test_run_scope_leaves_only_the_result(spark, sf_small):
    import glob
    from murmur.plans import catalog as CT
    from murmur.session import checkpoint_dir
    base = checkpoint_dir(spark).removeprefix("file:") + "/tables"
    before = set(glob.glob(base + "/*"))
    CT.QUERIES["similar_pairs"](spark, sf_small)
    left = set(glob.glob(base + "/*")) - before
    assert len(left) == 1 and "/result-" in left.pop()


def test_document_stream_reads_a_file_and_a_folder(spark, tmp_path):
    from murmur.plans import catalog as C
    from murmur.streaming import streams as ST
    rows = spark.createDataFrame([(k, f"good bad text{k}", "en", "s", 10) for k in range(40)], C.DOC_SCHEMA)
    rows.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    rows.filter("doc_id < 0").write.parquet(f"{tmp_path}/folder/labels.parquet")
    (tmp_path / "file").mkdir()
    rows.toPandas().to_parquet(tmp_path / "file" / "documents.parquet")
    score = lambda posts: posts.selectExpr("id", "1 AS sentiment", "0.5F AS sentiment_score", "1 AS analyze_status", "CAST(NULL AS STRING) AS error")
    for kind in ("folder", "file"):
        posts = C._doc_feed(spark, f"{tmp_path}/{kind}").selectExpr("doc_id AS id", "text AS content")
        out = spark.read.parquet(ST.run_scoring(posts, score))
        assert sorted(r.id for r in out.collect()) == list(range(40))
        assert out.select("_epoch").distinct().count() == (3 if kind == "folder" else 1)


@pytest.mark.parametrize("threshold", [0.3, 0.7])
def test_similarity_join_over_many_blocks(spark, monkeypatch, threshold):
    """Short and long texts, many of one L1 norm, dealt to many blocks: the pairs
    of brute force; texts that only share a term leave no rows."""
    import numpy as np
    import pyarrow as pa
    from murmur.operators import similarity as SIM
    rng = np.random.default_rng(8)
    size = np.where(np.arange(150) < 60, 1, rng.integers(2, 20, 150))
    dense = np.zeros((150, 60))
    for i, n in enumerate(size):
        dense[i, rng.choice(60, n, replace=False)] = rng.uniform(0.5, 2.0, n)
    dense[140] = dense[141] * 3
    weights = spark.createDataFrame([(i, f"t{k}", k + 1, float(dense[i, k])) for i, k in zip(*map(lambda x: x.tolist(), np.nonzero(dense)))],
                                    "uid long, term string, df long, weight double")
    monkeypatch.setattr(SIM, "LEAST_ENTRIES", 50)
    monkeypatch.setattr(SIM, "BLOCKS", 1000)
    deal, meet, pairs = SIM.block_table(SIM.packed(weights), threshold)
    assert max(d[2] for d in deal) > 1 and pairs > 20
    unit = dense / np.linalg.norm(dense, axis=1)[:, None]
    cos = unit @ unit.T
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if cos[i, j] >= threshold - 1e-9}
    got = {(r.i, r.j): r.similarity for r in SIM.similar_pairs(weights, threshold).collect()}
    assert set(got) == want and len(want) > 10
    assert all(abs(s - cos[i, j]) < 1e-9 for (i, j), s in got.items())
    # 300 texts that share the rarest term and nothing else: 44,850 pairs of postings, no candidate
    keys = [[1, *range(i + 10, i + 3010, 300)] for i in range(300)]
    rows = pa.table({"uid": range(300), "k": keys, "u": [[11 ** -0.5] * 11] * 300, "w1": [11 ** 0.5] * 300, "wx": [11 ** -0.5] * 300})
    block = SIM._Texts(rows, threshold)
    assert sum(len(i) for i, _ in SIM._candidates(block, block, threshold, True)) == 0


def test_terms_are_counted_where_their_text_lies(spark):
    """Texts are shuffled by their hash, tokens not at all; copies count."""
    from murmur.operators import tfidf as TF
    posts = spark.createDataFrame([(1, "red red fox"), (2, "red red fox"), (3, "fox"), (4, None)], "id long, content string")
    st = TF.text_stats(posts)
    plan = st.tf._jdf.queryExecution().executedPlan().toString()
    moves = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert moves and not any("term" in x for x in moves)
    assert sorted((r.term, r.c) for r in st.tf.collect()) == [("fox", 1), ("fox", 2), ("red", 4)]
    df = spark.createDataFrame([("fox", 3), ("red", 2)], "term string, df long")
    got = {(r.id, r.term): round(r.weight, 6) for r in TF.expand_to_posts(TF.tfidf(st, df).select("uid", "term", "weight"), st).collect()}
    import math
    assert got == {(i, t): round(w * math.log(4 / (1 + n)), 6) for i, t, w, n in
                   [(1, "red", 1.0, 2), (2, "red", 1.0, 2), (1, "fox", 0.75, 3), (2, "fox", 0.75, 3), (3, "fox", 1.0, 3)]}
