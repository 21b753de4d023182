"""The registered queries: one callable (spark, sf_dir) -> DataFrame per operator,
and the DuckDB SQL that checks it.

Every query reads the driver tables at ``sf_dir`` through the FIXTURES
mappings and runs over whole tables.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import listing as L
from ..operators import reports as R
from ..session import cut, finish, scratch_path
from ..sources import tables as TB
from ..sources.keyed import KeyedTable
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

AS_OF = TB.AS_OF


def register(name: str, sql: str | None = None, scoped: bool = False):
    """``scoped``: the query's intermediate tables are dropped when its result is written."""
    def deco(fn):
        QUERIES[name] = (lambda spark, d: finish(spark, lambda: fn(spark, d))) if scoped else fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _E(spark, d):
    return TB.posts_event(spark, d)


def _D(spark, d):
    return TB.posts_doc(spark, d)


# ---------------------------------------------------------------- reports (A*)

@register("sentiment_trend", O.with_ctes("""
SELECT strftime(publish_time, '%Y-%m-%d %H:00:00') AS hour,
       COUNT(*) AS total,
       CAST(SUM(CASE WHEN sentiment = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positive,
       CAST(SUM(CASE WHEN sentiment = 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative
FROM posts_event
WHERE publish_time >= TIMESTAMP '2024-01-23 12:00:00' AND sentiment IS NOT NULL
GROUP BY 1 ORDER BY 1""", "posts_event"))
def q_sentiment_trend(spark, d):
    return R.sentiment_trend(_E(spark, d), 168, AS_OF)


@register("region_stats", O.with_ctes("""
SELECT province, COUNT(*) AS total,
       CAST(SUM(CASE WHEN sentiment = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positive
FROM posts_event
WHERE province IS NOT NULL AND sentiment IS NOT NULL
  AND publish_time >= TIMESTAMP '2024-01-20 12:00:00'
GROUP BY province""", "posts_event"))
def q_region_stats(spark, d):
    return R.region_stats(_E(spark, d), 240, AS_OF)


@register("platform_stats", O.with_ctes("""
SELECT platform, COUNT(*) AS total FROM posts_event
WHERE publish_time >= TIMESTAMP '2023-12-31 12:00:00' GROUP BY platform""", "posts_event"))
def q_platform_stats(spark, d):
    return R.platform_stats(_E(spark, d), 720, AS_OF)


@register("dashboard_stats", O.with_ctes("""
SELECT (SELECT COUNT(*) FROM posts_event WHERE crawl_time >= TIMESTAMP '2024-01-30 00:00:00'
          AND crawl_time < TIMESTAMP '2024-01-31 00:00:00') AS today_count,
       (SELECT COUNT(*) FROM posts_event WHERE analyze_status = 0) AS pending_count,
       (SELECT COUNT(*) FROM alerts WHERE NOT is_read) AS unread_alerts,
       (SELECT COUNT(*) FROM posts_event WHERE crawl_time >= TIMESTAMP '2024-01-30 00:00:00'
          AND crawl_time < TIMESTAMP '2024-01-31 00:00:00' AND sentiment = 1) AS positive,
       (SELECT COUNT(*) FROM posts_event WHERE crawl_time >= TIMESTAMP '2024-01-30 00:00:00'
          AND crawl_time < TIMESTAMP '2024-01-31 00:00:00' AND sentiment = 0) AS negative
""", "posts_event", "alerts"))
def q_dashboard_stats(spark, d):
    return R.dashboard_stats(_E(spark, d), TB.alerts(spark, d), AS_OF)


@register("negative_ratio", O.with_ctes("""
SELECT COUNT(sentiment) AS total,
       CAST(SUM(CASE WHEN sentiment = 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative,
       round(SUM(CASE WHEN sentiment = 0 THEN 1 ELSE 0 END) / COUNT(sentiment), 6) AS ratio
FROM posts_event WHERE crawl_time >= TIMESTAMP '2024-01-29 12:00:00'""", "posts_event"))
def q_negative_ratio(spark, d):
    return R.negative_ratio(_E(spark, d), 24, AS_OF)


@register("topic_growth", O.with_ctes("""
SELECT t.id AS topic_id, c.current_count, c.previous_count,
       round(c.current_count / c.previous_count, 6) AS growth
FROM hot_topics t
JOIN (SELECT topic_id,
             COUNT(*) FILTER (WHERE crawl_time >= TIMESTAMP '2024-01-10 12:00:00') AS current_count,
             COUNT(*) FILTER (WHERE crawl_time < TIMESTAMP '2024-01-10 12:00:00') AS previous_count
      FROM posts_event WHERE topic_id IS NOT NULL GROUP BY topic_id) c ON c.topic_id = t.id
WHERE t.status = 'active' AND t.last_updated >= TIMESTAMP '2024-01-10 12:00:00'
  AND t.first_seen IS NOT NULL AND c.previous_count >= 5""", "hot_topics"))
def q_topic_growth(spark, d):
    g = R.topic_growth(TB.hot_topics(spark, d), _E(spark, d), 480, AS_OF)
    return g.select("topic_id", "current_count", "previous_count",
                    F.round("growth", 6).alias("growth"))


@register("health_status", O.with_ctes("""
SELECT module_name, arg_max(status, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || status) AS status,
       max(CASE WHEN status = 'healthy' THEN ts END) AS last_success,
       max(ts) AS last_heartbeat
FROM heartbeats GROUP BY module_name""", "heartbeats"))
def q_health_status(spark, d):
    return R.health_status(TB.heartbeats(spark, d))


# ------------------------------------------------------- scans and listings

_SCAN_COLS = ["id", "platform", "post_id", "analyze_status"]


@register("posts_scan", O.with_ctes(
    "SELECT id, platform, post_id, analyze_status FROM posts_doc", "posts_doc"))
def q_posts_scan(spark, d):
    return _D(spark, d).select(*_SCAN_COLS)


@register("post_by_id", O.with_ctes(
    "SELECT id, platform, post_id, analyze_status FROM posts_doc WHERE id = 42", "posts_doc"))
def q_post_by_id(spark, d):
    return L.by_id(_D(spark, d), 42).select(*_SCAN_COLS)


@register("pending_posts", O.with_ctes(
    "SELECT id, platform, post_id, analyze_status FROM posts_doc WHERE analyze_status = 0 "
    "ORDER BY id LIMIT 64", "posts_doc"))
def q_pending_posts(spark, d):
    return L.pending(_D(spark, d), 64).select(*_SCAN_COLS)


@register("clusterable_posts", O.with_ctes(
    "SELECT id, platform, post_id, analyze_status FROM posts_doc "
    "WHERE crawl_time >= TIMESTAMP '2023-12-31 12:00:00' AND analyze_status = 1 "
    "AND sentiment IS NOT NULL", "posts_doc"))
def q_clusterable_posts(spark, d):
    return L.clusterable(_D(spark, d), AS_OF, hours=720).select(*_SCAN_COLS)


_SEARCH_COLS = ["id", "platform", "author", "publish_time", "sentiment"]


@register("search_posts", O.with_ctes("""
SELECT id, platform, author, publish_time, sentiment FROM posts_doc
WHERE platform = 'weibo' AND contains(lower(content), 'the')
  AND publish_time >= TIMESTAMP '2024-01-05 00:00:00'
  AND publish_time <= TIMESTAMP '2024-01-25 00:00:00'
ORDER BY publish_time DESC, id DESC LIMIT 20 OFFSET 20""", "posts_doc"))
def q_search_posts(spark, d):
    return L.search_posts(_D(spark, d), platform="weibo", keyword="The",
                          start="2024-01-05 00:00:00", end="2024-01-25 00:00:00",
                          page=2, size=20).select(*_SEARCH_COLS)


@register("deep_page", O.with_ctes("""
SELECT id, platform, author, publish_time, sentiment FROM posts_event
ORDER BY publish_time DESC, id DESC LIMIT 20 OFFSET (SELECT COUNT(*) // 40 * 20 FROM posts_event)""", "posts_event"))
def q_deep_page(spark, d):
    """The page in the middle of all event posts, by the page directory."""
    posts = _E(spark, d)
    return L.search_posts(posts, page=posts.count() // 40 + 1, size=20).select(*_SEARCH_COLS)


@register("post_page", O.with_ctes("""
SELECT id, platform, author, publish_time, sentiment FROM posts_doc
ORDER BY publish_time DESC, id DESC LIMIT 20 OFFSET 40""", "posts_doc"))
def q_post_page(spark, d):
    return L.search_posts(_D(spark, d), page=3, size=20).select(*_SEARCH_COLS)


@register("post_page_info", O.with_ctes("""
SELECT COUNT(*) AS total, CAST(ceil(COUNT(*) / 20.0) AS BIGINT) AS pages, CAST(2 AS BIGINT) AS current
FROM posts_doc WHERE platform = 'weibo' AND contains(lower(content), 'the')
  AND publish_time >= TIMESTAMP '2024-01-05 00:00:00'
  AND publish_time <= TIMESTAMP '2024-01-25 00:00:00'""", "posts_doc"))
def q_post_page_info(spark, d):
    f = L.search_filter(_D(spark, d), platform="weibo", keyword="The",
                        start="2024-01-05 00:00:00", end="2024-01-25 00:00:00")
    return R.page_info(f, page=2, size=20)


_ALERT_COLS = ["id", "alert_type", "severity", "created_at"]


@register("alerts_by_severity", O.with_ctes("""
SELECT id, alert_type, severity, created_at FROM alerts WHERE severity = 'warning'
ORDER BY created_at DESC, id DESC LIMIT 20""", "alerts"))
def q_alerts_by_severity(spark, d):
    return L.list_alerts(TB.alerts(spark, d), "warning", 1, 20).select(*_ALERT_COLS)


@register("recent_alerts", O.with_ctes("""
SELECT id, alert_type, severity, created_at FROM alerts
ORDER BY created_at DESC, id DESC LIMIT 10""", "alerts"))
def q_recent_alerts(spark, d):
    return L.recent_alerts(TB.alerts(spark, d), 10).select(*_ALERT_COLS)


@register("mark_all_read", O.with_ctes(
    "SELECT id, true AS is_read, NOT coalesce(is_read, false) AS changed FROM alerts", "alerts"))
def q_mark_all_read(spark, d):
    return L.mark_all_read(TB.alerts(spark, d))


_TOPIC_COLS = ["id", "topic_name", "heat_score"]


@register("topics_by_status", O.with_ctes("""
SELECT id, topic_name, heat_score FROM hot_topics WHERE status = 'active'
ORDER BY heat_score DESC, id LIMIT 5 OFFSET 5""", "hot_topics"))
def q_topics_by_status(spark, d):
    return L.list_topics(TB.hot_topics(spark, d), "active", page=2, size=5).select(*_TOPIC_COLS)


@register("top_topics", O.with_ctes("""
SELECT id, topic_name, heat_score FROM hot_topics WHERE status = 'active'
ORDER BY heat_score DESC, id LIMIT 5""", "hot_topics"))
def q_top_topics(spark, d):
    return L.top_topics(TB.hot_topics(spark, d), 5).select(*_TOPIC_COLS)


@register("topic_rank", O.with_ctes("""
SELECT id, topic_name, heat_score, rank, rank <= 3 AS top3 FROM (
  SELECT id, topic_name, heat_score,
         CAST(row_number() OVER (ORDER BY heat_score DESC, id) AS BIGINT) AS rank
  FROM hot_topics WHERE status = 'active') WHERE rank <= 8""", "hot_topics"))
def q_topic_rank(spark, d):
    return L.topic_rank(TB.hot_topics(spark, d), 8).select(*_TOPIC_COLS, "rank", "top3")


@register("present_topics", O.with_ctes("""
SELECT id, topic_name, heat_score,
       CASE WHEN coalesce(sentiment_ratio, 0) > 0.5 THEN 'positive' ELSE 'negative' END AS heat_label,
       round(coalesce(sentiment_ratio, 0) * 100.0, 1) AS positive_pct,
       round(coalesce(heat_score, 0), 0) AS heat_display
FROM hot_topics""", "hot_topics"))
def q_present_topics(spark, d):
    return L.present_topics(TB.hot_topics(spark, d))


@register("present_posts", O.with_ctes("""
SELECT id, substr(content, 1, 100) AS preview, strftime(publish_time, '%m-%d %H:%M') AS short_time,
       strftime(publish_time, '%H:%M') AS hour_time,
       CASE sentiment WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'pending' END AS label
FROM posts_doc""", "posts_doc"))
def q_present_posts(spark, d):
    return L.present_posts(_D(spark, d))


@register("cool_topics", O.with_ctes("""
SELECT id, CASE WHEN status = 'active' AND last_updated < TIMESTAMP '2024-01-30 23:30:00'
                THEN 'cold' ELSE status END AS status
FROM hot_topics""", "hot_topics"))
def q_cool_topics(spark, d):
    return L.cool_topics(TB.hot_topics(spark, d), "2024-02-01 23:30:00", 48).select("id", "status")


@register("topic_posts", O.with_ctes("""
SELECT topic_id, id, publish_time, rn FROM (
  SELECT topic_id, id, publish_time,
         CAST(row_number() OVER (PARTITION BY topic_id ORDER BY publish_time DESC, id DESC) AS BIGINT) AS rn
  FROM posts_event WHERE topic_id IS NOT NULL) r
WHERE rn <= 50 AND topic_id IN (SELECT id FROM hot_topics)""", "hot_topics"))
def q_topic_posts(spark, d):
    return L.topic_posts(TB.hot_topics(spark, d), _E(spark, d), 50)


# ------------------------------------------------------------------ ingest (S*)

from ..functions import parse as P  # noqa: E402
from ..functions import text as TX  # noqa: E402
from ..sources import ingest as I  # noqa: E402

_INGEST_SQL = """,
existing AS (SELECT platform, post_id, author, likes, crawl_time FROM posts_doc
             WHERE crawl_time < TIMESTAMP '2024-01-10 00:00:00'),
arriving AS (SELECT platform, post_id, author, likes, crawl_time FROM posts_doc
             WHERE crawl_time >= TIMESTAMP '2024-01-07 00:00:00'
             UNION ALL
             SELECT platform, post_id, author, likes + 1, crawl_time + INTERVAL 1 HOUR FROM posts_doc
             WHERE crawl_time >= TIMESTAMP '2024-01-12 00:00:00'
             UNION ALL
             SELECT platform, post_id, concat('a', author), likes + 2,
                    CASE WHEN likes % 5 = 0 THEN NULL ELSE crawl_time END FROM posts_doc
             WHERE crawl_time >= TIMESTAMP '2024-01-18 00:00:00'),
incoming AS (SELECT platform, post_id, author, likes,
                    coalesce(crawl_time, TIMESTAMP '2024-01-30 12:00:00') AS crawl_time FROM arriving),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY platform, post_id
                                                        ORDER BY crawl_time, author, likes) AS rn FROM incoming)
           WHERE rn = 1),
lasts AS (SELECT platform, post_id, likes AS last_likes FROM (
            SELECT *, row_number() OVER (PARTITION BY platform, post_id
                                         ORDER BY crawl_time DESC, author DESC, likes DESC) AS rn FROM incoming)
          WHERE rn = 1)
"""


def _ingest_inputs(spark, d):
    """Stored posts, and a batch with posts crawled again later, others crawled
    twice at the same time with other values, and some without a crawl time."""
    p = _D(spark, d).select("platform", "post_id", "author", "likes", "crawl_time")
    since = lambda t: p.filter(F.col("crawl_time") >= F.lit(t).cast("timestamp_ntz"))
    existing = p.filter(F.col("crawl_time") < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    recrawl = since("2024-01-12 00:00:00").select("platform", "post_id", "author", (F.col("likes") + 1).alias("likes"),
                                                  F.expr("crawl_time + INTERVAL 1 HOUR").alias("crawl_time"))
    same = since("2024-01-18 00:00:00").select(
        "platform", "post_id", F.concat(F.lit("a"), "author").alias("author"), (F.col("likes") + 2).alias("likes"),
        F.when(F.col("likes") % 5 != 0, F.col("crawl_time")).alias("crawl_time"))
    return existing, since("2024-01-07 00:00:00").unionByName(recrawl).unionByName(same)


def _ingest_sql(body):
    return O.with_ctes(body, "posts_doc").replace(
        "LEFT JOIN labels l ON l.doc_id = d.doc_id)",
        "LEFT JOIN labels l ON l.doc_id = d.doc_id)" + _INGEST_SQL, 1)


@register("ingest_ignore", _ingest_sql("""
SELECT platform, post_id, author, likes, crawl_time FROM existing
UNION ALL
SELECT platform, post_id, author, likes, crawl_time FROM firsts f
WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.platform = f.platform AND e.post_id = f.post_id)"""))
def q_ingest_ignore(spark, d):
    existing, incoming = _ingest_inputs(spark, d)
    return I.ingest_ignore(existing, incoming, AS_OF)


@register("ingest_upsert", _ingest_sql("""
SELECT e.platform, e.post_id, e.author, coalesce(l.last_likes, e.likes) AS likes, e.crawl_time
FROM existing e LEFT JOIN lasts l ON l.platform = e.platform AND l.post_id = e.post_id
UNION ALL
SELECT f.platform, f.post_id, f.author, l.last_likes AS likes, f.crawl_time
FROM firsts f JOIN lasts l ON l.platform = f.platform AND l.post_id = f.post_id
WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.platform = f.platform AND e.post_id = f.post_id)"""))
def q_ingest_upsert(spark, d):
    existing, incoming = _ingest_inputs(spark, d)
    return I.ingest_upsert(existing, incoming, ["likes"], AS_OF)


@register("ingest_delta", _ingest_sql("""
SELECT b.platform, b.before, a.after, a.after - b.before AS saved
FROM (SELECT platform, COUNT(*) AS before FROM existing GROUP BY platform) b
JOIN (SELECT platform, COUNT(*) AS after FROM (
        SELECT platform, post_id FROM existing
        UNION ALL
        SELECT platform, post_id FROM firsts f
        WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.platform = f.platform
                          AND e.post_id = f.post_id)) GROUP BY platform) a
  ON a.platform = b.platform"""))
def q_ingest_delta(spark, d):
    existing, incoming = _ingest_inputs(spark, d)
    return I.ingest_delta(existing, I.ingest_ignore(existing, incoming, AS_OF))


@register("ingest_written", _ingest_sql("""
SELECT strftime(crawl_time, '%Y-%m-%d') AS crawl_day, COUNT(*) AS posts, CAST(SUM(likes) AS BIGINT) AS likes
FROM (SELECT likes, crawl_time FROM existing
      UNION ALL
      SELECT likes, crawl_time FROM firsts f
      WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.platform = f.platform AND e.post_id = f.post_id))
GROUP BY 1"""))
def q_ingest_written(spark, d):
    """S5 + S12: the posts after an ingest run written by crawl date, read back
    and counted by their partition."""
    existing, incoming = _ingest_inputs(spark, d)
    path = scratch_path(spark, "posts")
    I.write_posts(I.ingest_ignore(existing, incoming, AS_OF), path)
    return (spark.read.parquet(path).groupBy(F.date_format("crawl_date", "yyyy-MM-dd").alias("crawl_day"))
                 .agg(F.count(F.lit(1)).alias("posts"), F.sum("likes").alias("likes")))


@register("ingest_keyed", ORACLE["ingest_ignore"])
def q_ingest_keyed(spark, d):
    """S3 on the keyed table: the stored posts, then the batch, twice."""
    existing, incoming = _ingest_inputs(spark, d)
    table = KeyedTable(spark, scratch_path(spark, "keyed"))
    table.append(existing)
    for _ in range(2):
        table.insert_ignore(incoming, AS_OF)
    return table.read()


@register("upsert_keyed", ORACLE["ingest_upsert"])
def q_upsert_keyed(spark, d):
    """S4 on the keyed table."""
    existing, incoming = _ingest_inputs(spark, d)
    table = KeyedTable(spark, scratch_path(spark, "keyed"))
    table.append(existing)
    table.upsert(incoming, ["likes"], AS_OF)
    return table.read()


@register("ingest_defaults", O.with_ctes("""
SELECT platform, post_id,
       coalesce(nullif(trim(CASE WHEN likes % 7 = 0 THEN ' ' ELSE author END), ''),
                CASE WHEN platform = 'xiaohongshu' THEN '小红书用户' ELSE '未知用户' END) AS author,
       coalesce(CASE WHEN likes % 5 = 0 THEN NULL ELSE likes END, 0) AS likes
FROM posts_doc""", "posts_doc"))
def q_ingest_defaults(spark, d):
    # Stand-in gaps: blank authors and missing counters, as a collector delivers them.
    raw = _D(spark, d).select(
        "platform", "post_id",
        F.when(F.col("likes") % 7 == 0, F.lit(" ")).otherwise(F.col("author")).alias("author"),
        F.when(F.col("likes") % 5 == 0, F.lit(None)).otherwise(F.col("likes")).alias("likes"))
    return I.with_defaults(raw).select("platform", "post_id", "author", "likes")


@register("content_id", O.with_ctes("""
SELECT id, concat('wb_', md5(concat('weibo_', author, '_', content))) AS content_id
FROM posts_doc""", "posts_doc"))
def q_content_id(spark, d):
    p = _D(spark, d)
    return p.select("id", I.content_id(F.col("author"), F.col("content")).alias("content_id"))


@register("url_id", """
SELECT page_id,
       CASE WHEN len(list_filter(string_split(split_part(url, '?', 1), '/'),
                                 lambda p: regexp_full_match(p, '[a-f0-9]{24}'))) > 0
            THEN list_filter(string_split(split_part(url, '?', 1), '/'),
                             lambda p: regexp_full_match(p, '[a-f0-9]{24}'))[-1]
            ELSE md5(url) END AS url_id
FROM pages""")
def q_url_id(spark, d):
    pages = TB.read(spark, d, "pages").select("page_id", "url")
    return pages.select("page_id", I.note_id(F.col("url")).alias("url_id"))


@register("char_encode", O.with_ctes("""
SELECT id, CAST(len(list_filter(codes, lambda x: x > 0)) AS INT) AS n_codes,
       CAST(len(codes) AS INT) AS seq_len,
       CAST(list_sum(list_transform(codes, lambda x, i: CAST(x AS BIGINT) * i)) AS BIGINT) AS checksum
FROM (SELECT id, list_concat(
        list_transform(string_split(substr(content, 1, 1500), ''), lambda c: (unicode(c) % 498) + 2),
        list_transform(range(1500 - length(substr(content, 1, 1500))), lambda x: 0)) AS codes
      FROM posts_doc)""", "posts_doc"))
def q_char_encode(spark, d):
    codes = TX.char_encode(F.col("content"))
    p = _D(spark, d).select("id", codes.alias("codes"))
    return p.select(
        "id",
        F.size(F.filter("codes", lambda x: x > 0)).alias("n_codes"),
        F.size("codes").alias("seq_len"),
        F.aggregate(F.transform("codes", lambda x, i: x.cast("long") * (i + 1)),
                    F.lit(0).cast("long"), lambda a, b: a + b).alias("checksum"))


def _time_texts(spark, d):
    """Stand-in scraped time strings in every supported format, one per event."""
    e = TB.read(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    et = F.col("event_type")
    txt = (F.when(et == "click", F.concat((F.col("user_id") % 60).cast("string"), F.lit(P.MINUTES_AGO)))
            .when(et == "view", F.concat((F.col("user_id") % 24).cast("string"), F.lit(P.HOURS_AGO)))
            .when((et == "purchase") & (F.col("user_id") % 3 == 0), F.lit(P.TODAY))
            .when(et == "purchase", F.concat(F.lit(P.TODAY + " "), F.date_format("ts", "HH:mm")))
            .when((et == "signup") & (F.col("event_id") % 2 == 0), F.date_format("ts", "MM-dd HH:mm"))
            .when(et == "signup", F.date_format("ts", "MM月dd日 HH:mm"))
            .when(F.col("user_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm"))
            .otherwise(F.lit("garbage")))
    return e.select(F.col("event_id").alias("id"), txt.alias("text"))


@register("parse_time", """
WITH t AS (
  SELECT event_id AS id,
         CASE WHEN event_type = 'click' THEN concat(CAST(user_id % 60 AS VARCHAR), '分钟前')
              WHEN event_type = 'view' THEN concat(CAST(user_id % 24 AS VARCHAR), '小时前')
              WHEN event_type = 'purchase' AND user_id % 3 = 0 THEN '今天'
              WHEN event_type = 'purchase' THEN concat('今天 ', strftime(ts, '%H:%M'))
              WHEN event_type = 'signup' AND event_id % 2 = 0 THEN strftime(ts, '%m-%d %H:%M')
              WHEN event_type = 'signup' THEN strftime(ts, '%m月%d日 %H:%M')
              WHEN user_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M')
              ELSE 'garbage' END AS text
  FROM events),
c AS (SELECT id, text,
             CAST(nullif(regexp_replace(text, '\\D+', '', 'g'), '') AS BIGINT) AS n,
             trim(regexp_replace(trim(replace(replace(trim(text), '月', '-'), '日', ' ')), '\\s+', ' ', 'g')) AS cleaned
      FROM t)
SELECT id, text,
       CASE WHEN text LIKE '%分钟前%' THEN coalesce(TIMESTAMP '2024-01-30 12:00:00' - n * INTERVAL 1 MINUTE, TIMESTAMP '2024-01-30 12:00:00')
            WHEN text LIKE '%小时前%' THEN coalesce(TIMESTAMP '2024-01-30 12:00:00' - n * INTERVAL 1 HOUR, TIMESTAMP '2024-01-30 12:00:00')
            WHEN text LIKE '%今天%' THEN coalesce(
                 try_strptime(concat('2024-01-30 ', regexp_extract(trim(text), '^今天\\s*(\\d{1,2}:\\d{2})', 1)), '%Y-%m-%d %H:%M'),
                 CASE WHEN regexp_extract(trim(text), '^今天\\s*(\\d{1,2}:\\d{2})', 1) = '' THEN TIMESTAMP '2024-01-30 12:00:00' END,
                 TIMESTAMP '2024-01-30 12:00:00')
            WHEN regexp_full_match(cleaned, '\\d{2}-\\d{2}\\s+\\d{2}:\\d{2}') THEN coalesce(
                 try_strptime(concat('2024-', cleaned), '%Y-%m-%d %H:%M'), TIMESTAMP '2024-01-30 12:00:00')
            ELSE coalesce(try_strptime(cleaned, '%Y-%m-%d %H:%M'), TIMESTAMP '2024-01-30 12:00:00')
       END AS parsed
FROM c""")
def q_parse_time(spark, d):
    t = _time_texts(spark, d)
    return t.select("id", "text", P.parse_time(F.col("text"), AS_OF).alias("parsed"))


def _count_texts(spark, d):
    """Stand-in scraped counter strings: 万 amounts, separators, plain, label-only, empty."""
    e = TB.read(spark, d, "events").select("event_id", "value", "event_type")
    n = F.floor(F.col("value") * 100).cast("long")
    et = F.col("event_type")
    wan = F.concat(F.floor(n / 100).cast("long").cast("string"), F.lit("."),
                   F.lpad((n % 100).cast("string"), 2, "0"), F.lit(P.TEN_THOUSAND))
    sep = F.when(n >= 1000, F.concat(F.floor(n / 1000).cast("long").cast("string"), F.lit(","),
                                     F.lpad((n % 1000).cast("string"), 3, "0"))) \
           .otherwise(n.cast("string"))
    txt = (F.when(et == "purchase", wan).when(et == "view", sep)
            .when(et == "click", F.floor("value").cast("long").cast("string"))
            .when(et == "error", F.lit("赞")).otherwise(F.lit("")))
    return e.select(F.col("event_id").alias("id"), txt.alias("text"))


@register("parse_count", """
WITH t AS (
  SELECT event_id AS id,
         CASE WHEN event_type = 'purchase' THEN concat(CAST(CAST(floor(value * 100) AS BIGINT) // 100 AS VARCHAR), '.',
                                                      lpad(CAST(CAST(floor(value * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0'), '万')
              WHEN event_type = 'view' THEN CASE WHEN floor(value * 100) >= 1000
                   THEN concat(CAST(CAST(floor(value * 100) AS BIGINT) // 1000 AS VARCHAR), ',',
                               lpad(CAST(CAST(floor(value * 100) AS BIGINT) % 1000 AS VARCHAR), 3, '0'))
                   ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) END
              WHEN event_type = 'click' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
              WHEN event_type = 'error' THEN '赞'
              ELSE '' END AS text
  FROM events)
SELECT id, text,
       CASE WHEN contains(replace(trim(text), ',', ''), '万')
            THEN coalesce(CAST(floor(TRY_CAST(trim(replace(replace(trim(text), ',', ''), '万', '')) AS DECIMAL(20,4)) * 10000) AS BIGINT), 0)
            ELSE coalesce(CAST(nullif(regexp_extract(replace(trim(text), ',', ''), '(\\d+)', 1), '') AS BIGINT), 0)
       END AS value
FROM t""")
def q_parse_count(spark, d):
    t = _count_texts(spark, d)
    return t.select("id", "text", P.parse_count(F.col("text")).alias("value"))


# ------------------------------------------------------------------ alerts (L*)

from ..operators import alerts as AL  # noqa: E402
from ..operators import notify as N  # noqa: E402

HIT_WORDS = ["password", "License", "secret", "@", "the"]


@register("keyword_hits", O.with_ctes("""
SELECT id, CASE WHEN contains(content, 'password') THEN 'password'
                WHEN contains(content, 'License') THEN 'License'
                WHEN contains(content, 'secret') THEN 'secret'
                WHEN contains(content, '@') THEN '@'
                WHEN contains(content, 'the') THEN 'the' END AS matched_word
FROM posts_doc
WHERE contains(content, 'password') OR contains(content, 'License') OR contains(content, 'secret')
   OR contains(content, '@') OR contains(content, 'the')""", "posts_doc"))
def q_keyword_hits(spark, d):
    return AL.keyword_hits(_D(spark, d), HIT_WORDS)


@register("alert_keyword", O.with_ctes("""
SELECT id, matched_word, 'warning' AS severity, concat('敏感词触发: ', matched_word) AS title,
       substr(content, 1, 80) AS content_preview
FROM (SELECT id, content,
             CASE WHEN contains(content, 'error') THEN 'error'
                  WHEN contains(content, 'purchase') THEN 'purchase' END AS matched_word
      FROM posts_event WHERE crawl_time >= TIMESTAMP '2024-01-29 12:00:00')
WHERE matched_word IS NOT NULL""", "posts_event"))
def q_alert_keyword(spark, d):
    a = AL.keyword_alerts(_E(spark, d), ["error", "purchase"], AS_OF, lookback_minutes=24 * 60)
    return a.select("id", "matched_word", "severity", "title", "content_preview")


MONITOR_ROWS = [("purchase", "all", True), ("error", "weibo", True), ('"k": 1', "xiaohongshu", True),
                ("AI", "all", True), ("view", "all", False)]


@register("monitored_posts", O.with_ctes("""
SELECT k.keyword, p.platform, COUNT(*) AS hits
FROM posts_event p
JOIN (VALUES ('purchase', 'all', true), ('error', 'weibo', true), ('"k": 1', 'xiaohongshu', true),
             ('AI', 'all', true), ('view', 'all', false)) k(keyword, platform, enabled)
  ON k.enabled AND (k.platform = 'all' OR k.platform = p.platform)
 AND contains(lower(p.content), lower(k.keyword))
GROUP BY k.keyword, p.platform""", "posts_event"))
def q_monitored_posts(spark, d):
    return AL.monitored_posts(_E(spark, d), TB.keywords_table(spark, MONITOR_ROWS))


@register("alert_negative_surge", O.with_ctes("""
SELECT 'negative_surge' AS alert_type,
       CASE WHEN negative_posts / total_posts >= 0.8 THEN 'critical' ELSE 'warning' END AS severity,
       total_posts, negative_posts,
       floor(negative_posts / total_posts * 1000.0 + 0.5) / 10.0 AS negative_ratio
FROM (SELECT COUNT(sentiment) AS total_posts, COUNT(*) FILTER (WHERE sentiment = 0) AS negative_posts
      FROM posts_event WHERE crawl_time >= TIMESTAMP '2024-01-29 12:00:00')
WHERE total_posts >= 5 AND negative_posts / total_posts >= 0.4""", "posts_event"))
def q_alert_negative_surge(spark, d):
    a = AL.negative_surge(_E(spark, d), AS_OF, threshold=0.4, min_posts=5, window_hours=24)
    return a.select("alert_type", "severity", "total_posts", "negative_posts", "negative_ratio")


@register("alert_surge_baseline", O.with_ctes("""
SELECT total_posts, negative_posts FROM (
  SELECT COUNT(sentiment) FILTER (WHERE now) AS total_posts, COUNT(*) FILTER (WHERE now AND sentiment = 0) AS negative_posts,
         COUNT(sentiment) FILTER (WHERE NOT now) AS bn, COUNT(*) FILTER (WHERE NOT now AND sentiment = 0) AS bneg
  FROM (SELECT sentiment, crawl_time >= TIMESTAMP '2024-01-29 12:00:00' AS now FROM posts_event
        WHERE crawl_time >= TIMESTAMP '2024-01-26 12:00:00'))
WHERE total_posts >= 5 AND negative_posts / total_posts >= 0.3 AND bn > 0
  AND negative_posts / total_posts - bneg / bn >= -0.1""", "posts_event"))
def q_alert_surge_baseline(spark, d):
    """L1 with its optional condition: the last day against the three days before."""
    a = AL.negative_surge(_E(spark, d), AS_OF, threshold=0.3, min_posts=5, window_hours=24, baseline_hours=72, baseline_threshold=-0.1)
    return a.select("total_posts", "negative_posts")


@register("topic_growth_equal", O.with_ctes("""
SELECT t.id AS topic_id, c.current_count, c.previous_count, round(c.current_count / c.previous_count, 6) AS growth
FROM hot_topics t
JOIN (SELECT topic_id, COUNT(*) FILTER (WHERE crawl_time >= TIMESTAMP '2024-01-25 12:00:00') AS current_count,
             COUNT(*) FILTER (WHERE crawl_time < TIMESTAMP '2024-01-25 12:00:00') AS previous_count
      FROM posts_event WHERE topic_id IS NOT NULL AND crawl_time >= TIMESTAMP '2024-01-20 12:00:00' GROUP BY topic_id) c ON c.topic_id = t.id
WHERE t.status = 'active' AND t.last_updated >= TIMESTAMP '2024-01-25 12:00:00'
  AND t.first_seen IS NOT NULL AND c.previous_count >= 5""", "hot_topics"))
def q_topic_growth_equal(spark, d):
    """A8 with the window of equal length: five days against the five before."""
    g = R.topic_growth(TB.hot_topics(spark, d), _E(spark, d), 120, AS_OF, equal_window=True)
    return g.select("topic_id", "current_count", "previous_count", F.round("growth", 6).alias("growth"))


@register("alert_topic_growth", O.with_ctes("""
SELECT topic_id, CASE WHEN g >= 1 + 2 * 0.6 THEN 'critical' ELSE 'warning' END AS severity,
       current_count, previous_count, floor(g * 100 + 0.5) / 100 AS growth_rate
FROM (SELECT t.id AS topic_id, c.current_count, c.previous_count,
             c.current_count / c.previous_count AS g
      FROM hot_topics t
      JOIN (SELECT topic_id,
                   COUNT(*) FILTER (WHERE crawl_time >= TIMESTAMP '2024-01-10 12:00:00') AS current_count,
                   COUNT(*) FILTER (WHERE crawl_time < TIMESTAMP '2024-01-10 12:00:00') AS previous_count
            FROM posts_event WHERE topic_id IS NOT NULL GROUP BY topic_id) c ON c.topic_id = t.id
      WHERE t.status = 'active' AND t.last_updated >= TIMESTAMP '2024-01-10 12:00:00'
        AND t.first_seen IS NOT NULL AND c.previous_count >= 5)
WHERE g >= 1 + 0.6""", "hot_topics"))
def q_alert_topic_growth(spark, d):
    a = AL.topic_growth_alerts(TB.hot_topics(spark, d), _E(spark, d), AS_OF, rate=0.6, window_hours=480)
    return a.select("topic_id", "severity", "current_count", "previous_count", "growth_rate")


SILENCE_HOURS = {"negative_surge": 24, "keyword_trigger": 1, "topic_growth": 48}
SILENCE_SPLIT = "2024-01-25 00:00:00"


@register("alert_silence", O.with_ctes("""
SELECT c.id, c.alert_type, c.related_topic_id,
       EXISTS (SELECT 1 FROM alerts p
               WHERE p.created_at < TIMESTAMP '2024-01-25 00:00:00'
                 AND p.alert_type = c.alert_type
                 AND p.related_topic_id IS NOT DISTINCT FROM c.related_topic_id
                 AND p.created_at <= c.created_at
                 AND p.created_at >= c.created_at - (CASE c.alert_type WHEN 'negative_surge' THEN 24
                        WHEN 'keyword_trigger' THEN 1 ELSE 48 END) * INTERVAL 1 HOUR) AS suppressed
FROM alerts c WHERE c.created_at >= TIMESTAMP '2024-01-25 00:00:00'""", "alerts"))
def q_alert_silence(spark, d):
    a = TB.alerts(spark, d)
    split = F.lit(SILENCE_SPLIT).cast("timestamp_ntz")
    cand = a.filter(F.col("created_at") >= split)
    prior = a.filter(F.col("created_at") < split)
    return AL.silence(cand, prior, SILENCE_HOURS).select("id", "alert_type", "related_topic_id", "suppressed")


REPLAY_HOURS = {"negative_surge": 24, "keyword_trigger": 1, "topic_growth": 48}


def _replay_sql(source: str) -> str:
    """Every fired alert silences its key; ``source``: CTE (id, alert_type,
    related_topic_id, created_at)."""
    return f"""WITH RECURSIVE {source},
times AS (SELECT alert_type, related_topic_id, created_at AS t, min(id) AS first,
                 CASE alert_type WHEN 'negative_surge' THEN 24 WHEN 'keyword_trigger' THEN 1 ELSE 48 END * INTERVAL 1 HOUR AS s
          FROM hist GROUP BY 1, 2, 3),
walk(alert_type, related_topic_id, t) AS (
  SELECT alert_type, related_topic_id, min(t) FROM times GROUP BY 1, 2
  UNION ALL
  SELECT w.alert_type, w.related_topic_id, (SELECT min(x.t) FROM times x WHERE x.alert_type = w.alert_type
           AND x.related_topic_id IS NOT DISTINCT FROM w.related_topic_id AND x.t > w.t + x.s)
  FROM walk w WHERE w.t IS NOT NULL)
SELECT h.id, h.alert_type, h.related_topic_id,
       NOT EXISTS (SELECT 1 FROM walk w JOIN times x ON x.alert_type = w.alert_type AND x.t = w.t
                     AND x.related_topic_id IS NOT DISTINCT FROM w.related_topic_id
                   WHERE w.alert_type = h.alert_type AND w.t = h.created_at AND x.first = h.id
                     AND w.related_topic_id IS NOT DISTINCT FROM h.related_topic_id) AS suppressed
FROM hist h"""


@register("alert_replay", _replay_sql(O.with_ctes("", "alerts").removeprefix("WITH ").rstrip()
                                      + ",\nhist AS (SELECT * FROM alerts)"), scoped=True)
def q_alert_replay(spark, d):
    """L5 over the whole alert history: every fired alert silences later ones."""
    return AL.replay(TB.alerts(spark, d), REPLAY_HOURS).select("id", "alert_type", "related_topic_id", "suppressed")


@register("negative_surge_backtest", O.with_ctes("""
SELECT e.minute, CAST(SUM(m.n) AS BIGINT) AS total, CAST(SUM(m.neg) AS BIGINT) AS negative,
       round(SUM(m.neg) / SUM(m.n), 6) AS ratio,
       (SUM(m.n) >= 5 AND SUM(m.neg) / SUM(m.n) >= 0.6) AS fires
FROM (SELECT DISTINCT m + k * INTERVAL 1 MINUTE AS minute FROM mins, range(0, 60) r(k)) e
JOIN mins m ON m.m BETWEEN e.minute - INTERVAL 59 MINUTE AND e.minute
GROUP BY e.minute""", "posts_event", extra="""mins AS (
  SELECT date_trunc('minute', crawl_time) AS m, COUNT(*) AS n,
         COUNT(*) FILTER (WHERE sentiment = 0) AS neg
  FROM posts_event WHERE sentiment IS NOT NULL GROUP BY 1)"""))
def q_negative_surge_backtest(spark, d):
    return AL.negative_surge_backtest(_E(spark, d), 60, 0.6, 5)


_ISO_TIME = """(strftime(created_at, '%Y-%m-%dT%H:%M') ||
  CASE WHEN strftime(created_at, '%S') = '00' AND strftime(created_at, '%f') = '000000' THEN ''
       WHEN strftime(created_at, '%f') = '000000' THEN ':' || strftime(created_at, '%S')
       WHEN substr(strftime(created_at, '%f'), 4, 3) = '000'
            THEN ':' || strftime(created_at, '%S') || '.' || substr(strftime(created_at, '%f'), 1, 3)
       ELSE ':' || strftime(created_at, '%S') || '.' || strftime(created_at, '%f') END)"""
_SEV = ("CASE severity WHEN 'critical' THEN '严重' WHEN 'warning' THEN '警告' "
        "WHEN 'info' THEN '提示' ELSE severity END")
_TYP = ("CASE alert_type WHEN 'negative_surge' THEN '负面舆情突增' WHEN 'keyword_trigger' "
        "THEN '敏感词触发' WHEN 'topic_growth' THEN '话题异常增长' ELSE alert_type END")


@register("notification_outbox", O.with_ctes(f"""
SELECT id AS alert_id, 'email' AS channel,
       CAST(json_object('subject', '[舆情预警] ' || title,
                        'text', '舆情分析平台预警通知' || chr(10) || '========================' || chr(10) || chr(10)
                          || '级别: ' || {_SEV} || chr(10) || '类型: ' || {_TYP} || chr(10)
                          || '标题: ' || title || chr(10) || '详情: ' || description || chr(10)
                          || '时间: ' || {_ISO_TIME} || chr(10) || chr(10) || '请及时处理。' || chr(10)) AS VARCHAR) AS payload
FROM alerts WHERE severity = 'critical'
UNION ALL
SELECT id AS alert_id, 'webhook' AS channel,
       CAST(json_object('msgtype', 'markdown', 'markdown', json_object('content',
            '### ' || CASE WHEN severity = 'critical' THEN '🔴' ELSE '🟡' END || ' 舆情预警' || chr(10)
            || '> 级别: **' || {_SEV} || '**' || chr(10) || '> 类型: ' || {_TYP} || chr(10)
            || '> 详情: ' || description || chr(10) || '> 时间: ' || {_ISO_TIME})) AS VARCHAR) AS payload
FROM alerts WHERE severity IN ('warning', 'critical')""", "alerts"))
def q_notification_outbox(spark, d):
    return N.notification_outbox(TB.alerts(spark, d), "wechat")


@register("notified_flags", O.with_ctes("""
SELECT id AS alert_id, coalesce(bool_or(d.ok), false) AS notified
FROM alerts a LEFT JOIN (SELECT event_id + 1 AS alert_id, value > 50 AS ok FROM events
                         UNION ALL SELECT event_id + 2, user_id % 7 = 0 FROM events) d ON d.alert_id = a.id
GROUP BY id""", "alerts"))
def q_notified_flags(spark, d):
    """Alerts with what their deliveries (two channels, mapped from the
    events) came to."""
    e = TB.read(spark, d, "events")
    sent = e.select((F.col("event_id") + 1).alias("alert_id"), F.lit("email").alias("channel"), (F.col("value") > 50).alias("ok"))
    hook = e.select((F.col("event_id") + 2).alias("alert_id"), F.lit("webhook").alias("channel"), (F.col("user_id") % 7 == 0).alias("ok"))
    return N.notified_flags(TB.alerts(spark, d), sent.unionByName(hook))


ORACLE_RULES = [
    (1, "Negative Surge", "negative_surge",
     '{"negativeRatioThreshold": 0.4, "minPostCount": 5, "windowHours": 24, "silenceHours": 24}', True),
    (2, "Keyword Trigger", "keyword_trigger",
     '{"sensitiveWords": ["error", "purchase"], "silenceHours": 1}', True),
    (3, "Topic Growth", "topic_growth",
     '{"growthRateThreshold": 1.1, "windowHours": 480, "silenceHours": 48}', True),
    (4, "Topic Growth Fast", "topic_growth",
     '{"growthRateThreshold": 0.2, "windowHours": 400, "silenceHours": 2}', True),
    (5, "Surge Wide", "negative_surge",
     '{"negativeRatioThreshold": 0.3, "minPostCount": 5, "windowHours": 240, "silenceHours": 1}', True),
    (6, "Off", "keyword_trigger", '{"sensitiveWords": ["view"], "silenceHours": 1}', False),
]


def _surge_sql(rule, ratio, least, hours, silence):
    return f"""SELECT {rule} AS rule_id, 'negative_surge' AS alert_type,
         CASE WHEN negative_posts / total_posts >= 0.8 THEN 'critical' ELSE 'warning' END AS severity,
         '负面舆情突增预警' AS title, CAST(NULL AS BIGINT) AS related_topic_id, {silence} AS silence,
         CAST(NULL AS BIGINT) AS source_id
  FROM (SELECT COUNT(sentiment) AS total_posts, COUNT(*) FILTER (WHERE sentiment = 0) AS negative_posts
        FROM posts_event WHERE crawl_time >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL {hours} HOUR)
  WHERE total_posts >= {least} AND negative_posts / total_posts >= {ratio}"""


def _growth_sql(rule, rate, hours, silence):
    return f"""SELECT {rule}, 'topic_growth', CASE WHEN g >= 1 + 2 * {rate} THEN 'critical' ELSE 'warning' END,
         concat('话题异常增长: ', topic_name), topic_id, {silence}, topic_id
  FROM (SELECT t.id AS topic_id, t.topic_name, c.current_count / c.previous_count AS g, c.previous_count
        FROM hot_topics t
        JOIN (SELECT topic_id,
                     COUNT(*) FILTER (WHERE crawl_time >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL {hours} HOUR) AS current_count,
                     COUNT(*) FILTER (WHERE crawl_time < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL {hours} HOUR) AS previous_count
              FROM posts_event WHERE topic_id IS NOT NULL GROUP BY topic_id) c ON c.topic_id = t.id
        WHERE t.status = 'active' AND t.last_updated >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL {hours} HOUR
          AND t.first_seen IS NOT NULL)
  WHERE previous_count >= 5 AND g >= 1 + {rate}"""


_PRIOR = "TIMESTAMP '2024-01-29 13:00:00'"    # alerts before this time are the stored ones


@register("alerts_all", O.with_ctes(f"""
SELECT rule_id, alert_type, severity, title, related_topic_id, TIMESTAMP '2024-01-30 12:00:00' AS created_at, source_id,
       prior OR coalesce((rule_id, coalesce(source_id, -4611686018427387904)) >
                min(CASE WHEN NOT prior THEN (rule_id, coalesce(source_id, -4611686018427387904)) END)
                  OVER (PARTITION BY alert_type, related_topic_id), false) AS suppressed
FROM (SELECT c.*, EXISTS (SELECT 1 FROM alerts a WHERE a.alert_type = c.alert_type AND a.created_at < {_PRIOR}
               AND a.related_topic_id IS NOT DISTINCT FROM c.related_topic_id
               AND a.created_at >= TIMESTAMP '2024-01-30 12:00:00' - c.silence * INTERVAL 1 HOUR) AS prior
FROM (
  {_surge_sql(1, 0.4, 5, 24, 24)}
  UNION ALL
  SELECT 2, 'keyword_trigger', 'warning', concat('敏感词触发: ', w), CAST(NULL AS BIGINT), 1, id
  FROM (SELECT id, CASE WHEN contains(content, 'error') THEN 'error'
                        WHEN contains(content, 'purchase') THEN 'purchase' END AS w
        FROM posts_event WHERE crawl_time >= TIMESTAMP '2024-01-29 12:00:00')
  WHERE w IS NOT NULL
  UNION ALL
  {_growth_sql(3, 1.1, 480, 48)}
  UNION ALL
  {_growth_sql(4, 0.2, 400, 2)}
  UNION ALL
  {_surge_sql(5, 0.3, 5, 240, 1)}) c)""", "hot_topics", "alerts"), scoped=True)
def q_alerts_all(spark, d):
    """L4: all enabled rules over the posts, silenced against the alerts table."""
    rules = TB.rules_table(spark, ORACLE_RULES)
    prior = TB.alerts(spark, d).filter(F.col("created_at") < F.lit("2024-01-29 13:00:00").cast("timestamp_ntz"))
    out = AL.evaluate_rules(_E(spark, d), TB.hot_topics(spark, d), rules, prior,
                            AS_OF, keyword_lookback_minutes=24 * 60)
    return out.select(F.col("rule_id").cast("int").alias("rule_id"), "alert_type", "severity", "title", "related_topic_id", "created_at", "source_id",
                      "suppressed")


# ------------------------------------------------------- text and clustering

from ..operators import cluster as CL  # noqa: E402
from ..operators import similarity as SIM  # noqa: E402
from ..operators import tfidf as TF  # noqa: E402


def _duck_tokens(expr: str, stop: list[str]) -> str:
    stops = "[" + ", ".join("'" + w + "'" for w in stop) + "]"
    return (
        "list_filter(flatten(list_transform(regexp_split_to_array(lower(regexp_replace("
        f"coalesce({expr}, ''), '(\\p{{Han}}+)', ' \\1 ', 'g')), '[^\\p{{L}}\\p{{N}}]+'), "
        "lambda p: CASE WHEN regexp_full_match(p, '\\p{Han}+') AND length(p) >= 2 "
        "THEN list_transform(range(1, length(p)), lambda i: substr(p, i, 2)) ELSE [p] END)), "
        f"lambda w: length(w) >= 2 AND NOT list_contains({stops}, w))")


TOK_TOPIC = _duck_tokens("content", TX.STOP_WORDS_TOPIC)
TOK_KEYWORD = _duck_tokens("content", TX.STOP_WORDS_KEYWORD)

_TOKS = f"""toks AS (SELECT id, unnest({TOK_TOPIC}) AS term FROM posts_doc),
ptf AS (SELECT id, term, COUNT(*) AS tf FROM toks GROUP BY id, term),
pdf AS (SELECT term, COUNT(*) AS df FROM ptf GROUP BY term),
vocab AS (SELECT term, df FROM pdf WHERE df >= 2)"""


@register("tokens", O.with_ctes("SELECT id, term, tf FROM ptf", "posts_doc", extra=_TOKS))
def q_tokens(spark, d):
    return TF.post_tokens(_D(spark, d))


@register("doc_freq", O.with_ctes("SELECT term, df FROM pdf", "posts_doc", extra=_TOKS))
def q_doc_freq(spark, d):
    return TF.doc_freq(_D(spark, d))


@register("vocabulary", O.with_ctes("SELECT term, df FROM vocab", "posts_doc", extra=_TOKS))
def q_vocabulary(spark, d):
    return TF.vocabulary(TF.doc_freq(_D(spark, d)))


@register("tfidf", O.with_ctes("""
SELECT t.id, t.term,
       round((0.5 + 0.5 * t.tf / m.mc) * ln((SELECT COUNT(*) FROM posts_doc) / (1 + v.df)), 6) AS weight
FROM ptf t JOIN (SELECT id, max(tf) AS mc FROM ptf GROUP BY id) m ON m.id = t.id
JOIN vocab v ON v.term = t.term""", "posts_doc", extra=_TOKS))
def q_tfidf(spark, d):
    st = TF.text_stats(_D(spark, d))
    w = TF.tfidf(st, TF.vocabulary(TF.doc_freq(_D(spark, d))))
    return TF.expand_to_posts(w.select("uid", "term", F.round("weight", 6).alias("weight")), st)


@register("post_keywords", O.with_ctes(f"""
SELECT id, rank, term FROM (
  SELECT id, term, CAST(row_number() OVER (PARTITION BY id ORDER BY c DESC, term) AS BIGINT) AS rank
  FROM (SELECT id, term, COUNT(*) AS c
        FROM (SELECT id, unnest({TOK_KEYWORD}) AS term FROM posts_doc) GROUP BY id, term))
WHERE rank <= 5""", "posts_doc"))
def q_post_keywords(spark, d):
    return TF.post_keywords(_D(spark, d), 5)


def _cluster_ctes(threshold: float, min_samples: int, p: str = "", src: str = "posts_doc") -> str:
    """Clustering CTEs over ``src``; every CTE name carries the prefix ``p``."""
    return f"""{p}texts AS (SELECT content, min(id) AS uid, COUNT(*) AS mult FROM {src} GROUP BY content),
{p}post_uid AS (SELECT s.id, t.uid FROM {src} s JOIN {p}texts t ON t.content = s.content),
{p}ttok AS (SELECT uid, unnest({TOK_TOPIC}) AS term FROM {p}texts),
{p}tf AS (SELECT uid, term, COUNT(*) AS c FROM {p}ttok GROUP BY uid, term),
{p}mx AS (SELECT uid, max(c) AS mc FROM {p}tf GROUP BY uid),
{p}df AS (SELECT f.term, SUM(t.mult) AS df FROM {p}tf f JOIN {p}texts t ON t.uid = f.uid GROUP BY f.term),
{p}vocab AS (SELECT term, df FROM {p}df WHERE df >= 2),
{p}w AS (SELECT f.uid, f.term,
             (0.5 + 0.5 * f.c / m.mc) * ln((SELECT COUNT(*) FROM {src}) / (1 + v.df)) AS w
      FROM {p}tf f JOIN {p}mx m ON m.uid = f.uid JOIN {p}vocab v ON v.term = f.term),
{p}nrm AS (SELECT uid, sqrt(SUM(w * w)) AS nr FROM {p}w GROUP BY uid HAVING SUM(w * w) > 0),
{p}u AS (SELECT x.uid, x.term, x.w / n.nr AS u FROM {p}w x JOIN {p}nrm n ON n.uid = x.uid),
{p}pairs AS (SELECT a.uid AS i, b.uid AS j, SUM(a.u * b.u) AS sim
          FROM {p}u a JOIN {p}u b ON a.term = b.term AND a.uid < b.uid GROUP BY a.uid, b.uid
          HAVING SUM(a.u * b.u) >= {threshold} - 1e-9),
{p}edges AS (SELECT i AS src, j AS dst FROM {p}pairs UNION ALL SELECT j AS src, i AS dst FROM {p}pairs),
{p}deg AS (SELECT t.uid,
               (CASE WHEN t.uid IN (SELECT uid FROM {p}nrm) THEN t.mult ELSE 0 END)
               + coalesce((SELECT SUM(t2.mult) FROM {p}edges e JOIN {p}texts t2 ON t2.uid = e.dst
                           WHERE e.src = t.uid), 0) AS degree
        FROM {p}texts t),
{p}core AS (SELECT uid FROM {p}deg WHERE degree >= {min_samples}),
{p}cedges AS (SELECT src, dst FROM {p}edges
              WHERE src IN (SELECT uid FROM {p}core) AND dst IN (SELECT uid FROM {p}core)),
{p}reach(src, dst) AS (SELECT uid, uid FROM {p}core
                       UNION SELECT r.src, e.dst FROM {p}reach r JOIN {p}cedges e ON e.src = r.dst),
{p}comp AS (SELECT src AS uid, min(dst) AS label FROM {p}reach GROUP BY src),
{p}border AS (SELECT e.dst AS uid, min(c.label) AS label FROM {p}edges e JOIN {p}comp c ON c.uid = e.src
           WHERE e.dst NOT IN (SELECT uid FROM {p}core) GROUP BY e.dst),
{p}db_labels AS (SELECT uid, label FROM {p}comp UNION ALL SELECT uid, label FROM {p}border),
{p}ranked AS (SELECT k.uid, row_number() OVER (ORDER BY k.uid) AS rk,
                  (SELECT list(e.dst) FROM {p}cedges e WHERE e.src = k.uid) AS nbrs FROM {p}core k),
{p}walk(rk, centres) AS (SELECT 0, CAST([] AS BIGINT[])
                      UNION ALL
                      SELECT w.rk + 1, CASE WHEN list_has_any(w.centres, coalesce(r.nbrs, CAST([] AS BIGINT[])))
                                            THEN w.centres ELSE list_append(w.centres, r.uid) END
                      FROM {p}walk w JOIN {p}ranked r ON r.rk = w.rk + 1),
{p}centres AS (SELECT unnest(centres) AS uid FROM {p}walk WHERE rk = (SELECT max(rk) FROM {p}walk)),
{p}ld_labels AS (SELECT uid, min(label) AS label FROM (
                SELECT uid, uid AS label FROM {p}centres
                UNION ALL
                SELECT e.dst AS uid, e.src AS label FROM {p}edges e WHERE e.src IN (SELECT uid FROM {p}centres))
              GROUP BY uid)"""


def _cluster_sql(body: str, threshold: float, min_samples: int) -> str:
    s = O.with_ctes(body, "posts_doc", extra=_cluster_ctes(threshold, min_samples))
    return "WITH RECURSIVE " + s[len("WITH "):]


from . import clustering as PL  # noqa: E402


def _clusters(spark, d, eps, min_samples, method):
    p = PL.prepare(_D(spark, d), eps)
    return p, PL.post_labels(p, PL.labels(p, min_samples, method))


@register("similar_pairs", _cluster_sql(
    "SELECT i, j, round(sim, 6) AS similarity FROM pairs", 0.7, 5), scoped=True)
def q_similar_pairs(spark, d):
    st = TF.token_stats(TF.token_table(_D(spark, d)))
    pairs = SIM.vector_pairs(TF.text_vectors(st, cut(TF.vocabulary(TF.text_doc_freq(st)))), 0.7)
    return pairs.select("i", "j", F.round("similarity", 6).alias("similarity"))


@register("core_posts", _cluster_sql(
    "SELECT p.id, CAST(d.degree AS BIGINT) AS degree FROM post_uid p JOIN deg d ON d.uid = p.uid WHERE d.degree >= 5",
    0.7, 5), scoped=True)
def q_core_posts(spark, d):
    p = PL.prepare(_D(spark, d), 0.3)
    deg = CL.degrees(p.stats.texts, p.nonzero, p.pairs).filter(F.col("degree") >= 5)
    return deg.join(p.stats.members, "uid").select("id", "degree")


@register("dbscan_clusters", _cluster_sql(
    "SELECT p.id, l.label FROM post_uid p JOIN db_labels l ON l.uid = p.uid", 0.7, 5), scoped=True)
def q_dbscan_clusters(spark, d):
    return _clusters(spark, d, 0.3, 5, "dbscan")[1]


@register("leader_clusters", _cluster_sql(
    "SELECT p.id, l.label FROM post_uid p JOIN ld_labels l ON l.uid = p.uid", 0.7, 5), scoped=True)
def q_leader_clusters(spark, d):
    return _clusters(spark, d, 0.3, 5, "leader")[1]


@register("dbscan_clusters_wide", _cluster_sql(
    "SELECT p.id, l.label FROM post_uid p JOIN db_labels l ON l.uid = p.uid", 0.3, 3), scoped=True)
def q_dbscan_clusters_wide(spark, d):
    return _clusters(spark, d, 0.7, 3, "dbscan")[1]


@register("leader_clusters_wide", _cluster_sql(
    "SELECT p.id, l.label FROM post_uid p JOIN ld_labels l ON l.uid = p.uid", 0.3, 3), scoped=True)
def q_leader_clusters_wide(spark, d):
    return _clusters(spark, d, 0.7, 3, "leader")[1]


@register("cluster_summary", _cluster_sql("""
SELECT l.label, COUNT(*) AS size FROM post_uid p JOIN db_labels l ON l.uid = p.uid
GROUP BY l.label HAVING COUNT(*) >= 5""", 0.7, 5), scoped=True)
def q_cluster_summary(spark, d):
    return CL.cluster_summary(_clusters(spark, d, 0.3, 5, "dbscan")[1], 5)


# ------------------------------------------------------------------ topics (C*)

from ..operators import topics as TP  # noqa: E402


@register("topic_metrics", O.with_ctes("""
SELECT topic_id, COUNT(*) AS post_count,
       round(COUNT(*) FILTER (WHERE sentiment = 1) / COUNT(*), 6) AS sentiment_ratio,
       round(COUNT(*) * (1 + avg(coalesce(likes, 0)) / 100.0) * 1.0, 6) AS heat_score
FROM posts_event WHERE topic_id IS NOT NULL GROUP BY topic_id""", "posts_event"))
def q_topic_metrics(spark, d):
    m = TP.topic_metrics(_E(spark, d).filter(F.col("topic_id").isNotNull()), "topic_id")
    return m.select("topic_id", "post_count", F.round("sentiment_ratio", 6).alias("sentiment_ratio"),
                    F.round("heat_score", 6).alias("heat_score"))


@register("topic_heat_decay", O.with_ctes("""
SELECT topic_id, COUNT(*) AS post_count,
       round(COUNT(*) * (1 + avg(coalesce(likes, 0)) / 100.0)
             * pow(0.5, greatest(date_diff('second', date_trunc('second', max(crawl_time)), TIMESTAMP '2024-01-30 12:00:00') / 3600.0, 0) / 24.0), 3) AS heat_score
FROM posts_event WHERE topic_id IS NOT NULL AND crawl_time < TIMESTAMP '2024-01-30 12:00:00' GROUP BY topic_id""", "posts_event"))
def q_topic_heat_decay(spark, d):
    """A7 with its documented time decay: heat halves with every day of silence."""
    own = _E(spark, d).filter(F.col("topic_id").isNotNull() & (F.col("crawl_time") < F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")))
    own = own.withColumn("crawl_time", F.date_trunc("second", "crawl_time").cast("timestamp_ntz"))
    m = TP.topic_metrics(own, "topic_id", AS_OF, 24.0)
    return m.select("topic_id", "post_count", F.round("heat_score", 3).alias("heat_score"))


@register("topic_trend", O.with_ctes("""
SELECT topic_id, hour, ratio FROM (
  SELECT topic_id, hour, ratio, row_number() OVER (PARTITION BY topic_id ORDER BY hour DESC) AS rn
  FROM (SELECT topic_id, strftime(crawl_time, '%Y-%m-%d %H:00:00') AS hour,
               round(COUNT(*) FILTER (WHERE sentiment = 1) / COUNT(*), 6) AS ratio
        FROM posts_event WHERE topic_id IS NOT NULL AND sentiment IS NOT NULL GROUP BY 1, 2))
WHERE rn <= 72""", "posts_event"))
def q_topic_trend(spark, d):
    return TP.topic_trend(_E(spark, d))


def _kw_sql(labels: str, min_size: int, p: str = "", src: str = "posts_doc") -> str:
    return f"""(SELECT label, list(term ORDER BY rn) AS kws,
        string_agg(term, '/' ORDER BY rn) FILTER (WHERE rn <= 3) AS topic_name,
        string_agg(term, ',' ORDER BY rn) AS keywords
 FROM (SELECT label, term, row_number() OVER (PARTITION BY label ORDER BY cnt DESC, term) AS rn
       FROM (SELECT l.label, tk.term, COUNT(*) AS cnt
             FROM (SELECT id, unnest({TOK_TOPIC}) AS term FROM {src}) tk
             JOIN {p}post_uid pu ON pu.id = tk.id JOIN {p}{labels} l ON l.uid = pu.uid GROUP BY 1, 2))
 WHERE rn <= 8 AND label IN (SELECT l.label FROM {p}post_uid pu JOIN {p}{labels} l ON l.uid = pu.uid
                             GROUP BY l.label HAVING COUNT(*) >= {min_size})
 GROUP BY label)"""


@register("topic_terms", _cluster_sql(
    "SELECT label, topic_name, keywords FROM " + _kw_sql("db_labels", 5), 0.7, 5), scoped=True)
def q_topic_terms(spark, d):
    p = PL.prepare(_D(spark, d), 0.3)
    named, _ = PL.named_clusters(p, PL.labels(p, 5, "dbscan"), 5)
    return named.select("label", "topic_name", "keywords")


@register("topic_similarity", _cluster_sql(f"""
SELECT a.label, b.label AS topic_id,
       round(len(list_intersect(a.kws, b.kws)) / len(list_distinct(list_concat(a.kws, b.kws))), 6) AS jaccard
FROM {_kw_sql("db_labels", 3)} a, {_kw_sql("ld_labels", 3)} b
WHERE len(list_intersect(a.kws, b.kws)) / len(list_distinct(list_concat(a.kws, b.kws))) >= 0.5""", 0.3, 3), scoped=True)
def q_topic_similarity(spark, d):
    p = PL.prepare(_D(spark, d), 0.7)
    new = PL.named_clusters(p, PL.labels(p, 3, "dbscan"), 3)[0]
    old = PL.named_clusters(p, PL.labels(p, 3, "leader"), 3)[0]
    j = TP.jaccard_pairs(new, old.withColumnRenamed("label", "topic_id"), 0.5)
    return j.select("label", "topic_id", F.round("jaccard", 6).alias("jaccard"))


def _jac(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))))"


def _merge_sql(body: str) -> str:
    """Merge run in SQL: existing topics = leader clusters (cosine >= 0.3,
    min 3) of posts crawled before 2024-01-08, new clusters = DBSCAN of all
    posts; first topic id with Jaccard >= 0.5, creators by an ordered walk."""
    early = """posts_early AS (SELECT * FROM posts_doc WHERE crawl_time < TIMESTAMP '2024-01-08 00:00:00')"""
    metrics = """(SELECT l.label, COUNT(*) AS post_count,
                 COUNT(*) FILTER (WHERE s.sentiment = 1) / COUNT(*) AS sentiment_ratio,
                 COUNT(*) * (1 + avg(coalesce(s.likes, 0)) / 100.0) * 1.0 AS heat_score
          FROM {pu} pu JOIN {lab} l ON l.uid = pu.uid JOIN posts_doc s ON s.id = pu.id GROUP BY l.label)"""
    merge = f"""old_kw AS {_kw_sql("ld_labels", 3, "e_", "posts_early")},
topics AS (SELECT k.label AS id, k.topic_name, k.kws, m.post_count, m.sentiment_ratio, m.heat_score
           FROM old_kw k JOIN {metrics.format(pu="e_post_uid", lab="e_ld_labels")} m ON m.label = k.label),
new_kw AS {_kw_sql("db_labels", 3)},
clusters AS (SELECT k.label, k.topic_name, k.kws, m.post_count, m.sentiment_ratio, m.heat_score
             FROM new_kw k JOIN {metrics.format(pu="post_uid", lab="db_labels")} m ON m.label = k.label),
matched AS (SELECT c.label, min(t.id) AS topic_id FROM clusters c, topics t
            WHERE {_jac("c.kws", "t.kws")} >= 0.5 GROUP BY c.label),
unmatched AS (SELECT * FROM clusters WHERE label NOT IN (SELECT label FROM matched)),
uedges AS (SELECT a.label AS src, b.label AS dst FROM unmatched a, unmatched b
           WHERE a.label <> b.label AND {_jac("a.kws", "b.kws")} >= 0.5),
uranked AS (SELECT x.label, row_number() OVER (ORDER BY x.label) AS rk,
                   (SELECT list(e.dst) FROM uedges e WHERE e.src = x.label) AS nbrs FROM unmatched x),
uwalk(rk, made) AS (SELECT 0, CAST([] AS BIGINT[])
                    UNION ALL
                    SELECT w.rk + 1, CASE WHEN list_has_any(w.made, coalesce(r.nbrs, CAST([] AS BIGINT[])))
                                          THEN w.made ELSE list_append(w.made, r.label) END
                    FROM uwalk w JOIN uranked r ON r.rk = w.rk + 1),
creators AS (SELECT unnest(made) AS label FROM uwalk WHERE rk = (SELECT max(rk) FROM uwalk)),
base AS (SELECT coalesce(max(id), 0) + 1 AS b FROM topics),
assign AS (SELECT label, topic_id FROM matched
           UNION ALL SELECT c.label, (SELECT b FROM base) + c.label FROM creators c
           UNION ALL SELECT e.src, (SELECT b FROM base) + min(e.dst) FROM uedges e
                     WHERE e.dst IN (SELECT label FROM creators) AND e.src NOT IN (SELECT label FROM creators)
                     GROUP BY e.src),
inc AS (SELECT a.topic_id, SUM(c.post_count) AS m, SUM(c.sentiment_ratio * c.post_count) AS rm,
               max(c.heat_score) AS h
        FROM clusters c JOIN assign a ON a.label = c.label GROUP BY a.topic_id),
all_topics AS (SELECT id, topic_name, post_count, sentiment_ratio, heat_score,
                      '"2024-01-29 23:00:00":0.2500,"2024-01-30 11:00:00":' || CAST(sentiment_ratio AS DECIMAL(9,4)) AS trend
               FROM topics
               UNION ALL
               SELECT (SELECT b FROM base) + c.label, c.topic_name, 0, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), NULL
               FROM clusters c WHERE c.label IN (SELECT label FROM creators)),
merged AS (SELECT t.id, t.topic_name,
                  CASE WHEN i.m IS NULL THEN t.post_count ELSE t.post_count + i.m END AS post_count,
                  CASE WHEN i.m IS NULL THEN t.sentiment_ratio
                       ELSE (coalesce(t.sentiment_ratio, 0) * t.post_count + i.rm) / (t.post_count + i.m) END
                    AS sentiment_ratio,
                  CASE WHEN i.m IS NULL THEN t.heat_score ELSE greatest(coalesce(t.heat_score, i.h), i.h) END
                    AS heat_score,
                  'active' AS status,
                  CASE WHEN i.m IS NULL THEN '{{' || t.trend || '}}'
                       ELSE '{{' || coalesce(t.trend || ',', '') || '"2024-01-30 12:00:00":' || CAST(i.rm / i.m AS DECIMAL(9,4)) || '}}' END
                    AS sentiment_trend
           FROM all_topics t LEFT JOIN inc i ON i.topic_id = t.id)"""
    extra = ",\n".join([early, _cluster_ctes(0.3, 3, "e_", "posts_early"), _cluster_ctes(0.3, 3), merge])
    q = O.with_ctes(body, "posts_doc", extra=extra)
    return "WITH RECURSIVE " + q[len("WITH "):]


def _merge_run(spark, d):
    """Existing topics = leader clusters (eps 0.7, min 3) of the posts crawled
    before 2024-01-08; the run clusters all posts (DBSCAN eps 0.7, min 3)."""
    posts = _D(spark, d)
    tokens = TF.token_table(posts, "crawl_time")      # of both clusterings
    early = tokens.filter(F.col("crawl_time") < F.lit("2024-01-08 00:00:00").cast("timestamp_ntz"))
    old, _ = PL.cluster_topics(posts, PL.prepare(early, 0.7), 3, "leader")
    topics = cut(old.select(F.col("label").alias("id"), "topic_name", "keywords", "keyword_list", "post_count",
                            "sentiment_ratio", "heat_score", "first_seen", "last_updated",
                            F.lit("active").alias("status"),
                            # trends that grew by an entry an hour so far
                            F.concat(F.lit('{"2024-01-29 23:00:00":0.2500,"2024-01-30 11:00:00":'),
                                     F.col("sentiment_ratio").cast("decimal(9,4)").cast("string"), F.lit("}"))
                            .alias("sentiment_trend")))
    clusters, post_labels = PL.cluster_topics(posts, PL.prepare(tokens, 0.7), 3, "dbscan")
    merged, assign = TP.merge_topics(cut(clusters), topics, AS_OF, threshold=0.5)
    return posts, post_labels, merged, assign


@register("merge_topics", _merge_sql("""
SELECT id, topic_name, CAST(post_count AS BIGINT) AS post_count, round(sentiment_ratio, 6) AS sentiment_ratio,
       round(heat_score, 6) AS heat_score, status, sentiment_trend FROM merged"""), scoped=True)
def q_merge_topics(spark, d):
    _, _, merged, _ = _merge_run(spark, d)
    return merged.select("id", "topic_name", "post_count", F.round("sentiment_ratio", 6).alias("sentiment_ratio"),
                         F.round("heat_score", 6).alias("heat_score"), "status", "sentiment_trend")


@register("link_topics", _merge_sql("""
SELECT s.id, coalesce(a.topic_id, CASE WHEN s.likes % 3 = 0 THEN s.likes END) AS topic_id FROM posts_doc s
LEFT JOIN post_uid pu ON pu.id = s.id
LEFT JOIN db_labels l ON l.uid = pu.uid
LEFT JOIN assign a ON a.label = l.label"""), scoped=True)
def q_link_topics(spark, d):
    posts, post_labels, _, assign = _merge_run(spark, d)
    # a third of the posts has a topic from an earlier run: noise keeps it
    posts = posts.withColumn("topic_id", F.when(F.col("likes") % 3 == 0, F.col("likes")).cast("long"))
    return TP.link_topics(posts, post_labels, assign)


from ..operators import ledger as LG  # noqa: E402

# Three runs over windows that overlap; the second one moves the liked posts to
# the next topic.  A post belongs to the topic that the last run gave it.
_RUNS = [("2024-01-01 00:00:00", "2024-01-12 00:00:00", False), ("2024-01-08 00:00:00", "2024-01-20 00:00:00", True),
         ("2024-01-15 00:00:00", "2024-01-31 00:00:00", False)]
_RUNS_SQL = " UNION ALL ".join(
    f"SELECT {k} AS run, id, {'CASE WHEN likes >= 250 THEN (topic_id + 1) % 10 ELSE topic_id END' if moves else 'topic_id'} AS topic_id, "
    f"sentiment, likes FROM posts_event WHERE crawl_time >= TIMESTAMP '{a}' AND crawl_time < TIMESTAMP '{b}'"
    for k, (a, b, moves) in enumerate(_RUNS))


@register("link_ledger", O.with_ctes(f"""
SELECT topic_id, COUNT(*) AS post_count, round(COUNT(*) FILTER (WHERE sentiment = 1) / COUNT(*), 6) AS sentiment_ratio,
       round(COUNT(*) * (1 + avg(likes) / 100.0), 4) AS heat_score
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY run DESC) AS rn FROM ({_RUNS_SQL})) WHERE rn = 1
GROUP BY topic_id""", "posts_event"), scoped=True)
def q_link_ledger(spark, d):
    """The figures of every topic after three overlapping runs."""
    posts, ledger = _E(spark, d), spark.createDataFrame([], LG.SCHEMA)
    for k, (a, b, moves) in enumerate(_RUNS):
        topic = F.when((F.col("likes") >= 250) & F.lit(moves), (F.col("topic_id") + 1) % 10).otherwise(F.col("topic_id"))
        own = posts.filter((F.col("crawl_time") >= F.lit(a).cast("timestamp_ntz")) & (F.col("crawl_time") < F.lit(b).cast("timestamp_ntz")))
        ledger = cut(ledger.unionByName(LG.link_changes(ledger, own.select("id", topic.alias("topic_id"), "sentiment", "likes"), k)))
    return LG.topic_totals(ledger).select("topic_id", "post_count", F.round("sentiment_ratio", 6).alias("sentiment_ratio"),
                                          F.round("heat_score", 4).alias("heat_score"))


@register("surge_backtest_day", O.with_ctes("""
SELECT e.minute, CAST(SUM(m.n) AS BIGINT) AS total, CAST(SUM(m.neg) AS BIGINT) AS negative,
       round(SUM(m.neg) / SUM(m.n), 6) AS ratio, SUM(m.n) >= 20 AND SUM(m.neg) / SUM(m.n) >= 0.6 AS fires
FROM (SELECT unnest(range((SELECT min(m) FROM mins), (SELECT max(m) FROM mins) + INTERVAL 1440 MINUTE, INTERVAL 1 MINUTE)) AS minute) e
JOIN mins m ON m.m > e.minute - INTERVAL 1440 MINUTE AND m.m <= e.minute
GROUP BY e.minute""", "posts_event", extra="""mins AS (
  SELECT date_trunc('minute', crawl_time) AS m, COUNT(*) AS n, COUNT(*) FILTER (WHERE sentiment = 0) AS neg
  FROM posts_event WHERE sentiment IS NOT NULL GROUP BY 1)"""))
def q_surge_backtest_day(spark, d):
    """W2 with a window of a day: as much work as with one of an hour."""
    return AL.negative_surge_backtest(_E(spark, d), 1440, 0.6, 20)


from ..operators import textindex as TI  # noqa: E402

SEARCH_WORDS = ["The", "password", "tion is", "ñ", "zu", "no such words", "e"]


@register("search_indexed", O.with_ctes(f"""
SELECT k.keyword, p.id FROM posts_doc p, (SELECT unnest({SEARCH_WORDS}) AS keyword) k
WHERE contains(lower(p.content), lower(k.keyword))""", "posts_doc"), scoped=True)
def q_search_indexed(spark, d):
    """substring search through the gram index of all posts."""
    index = TI.build_text_index(_D(spark, d), scratch_path(spark, "grams"))
    return TI.search_indexed(index, spark.createDataFrame([(w,) for w in SEARCH_WORDS], "keyword string"))


# --------------------------------------------------------------- streaming (ST*)

from ..streaming import streams as ST  # noqa: E402


def _event_files(spark, d, parts: int = 4) -> tuple[str, int]:
    """The events cut by time into ``parts`` deliveries that arrive one after
    the other (stand-in for a feed; the ranges overlap by nothing): the folder
    and the files a delivery.  Every delivery is written by as many tasks as
    hold its rows."""
    path = scratch_path(spark, "feed")
    ev = TB.read(spark, d, "events")
    cuts = ev.selectExpr(f"percentile_approx(unix_micros(cast(ts as timestamp)), array({', '.join(str(k / parts) for k in range(1, parts))})) AS c").first()[0]
    t = F.expr("unix_micros(cast(ts as timestamp))")
    part = sum((F.when(t >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    ev = cut(ev.withColumn("_part", part).repartitionByRange("ts"))
    for k in range(parts):
        ev.filter(F.col("_part") == k).drop("_part").write.parquet(f"{path}/part{k}")
    files = len(spark.read.option("recursiveFileLookup", "true").schema(ST.EVENTS_SCHEMA).parquet(path).inputFiles())
    return path, max(1, files // parts)


def _event_feed(spark, d) -> DataFrame:
    path, files = _event_files(spark, d)
    feed = (spark.readStream.schema(ST.EVENTS_SCHEMA).option("recursiveFileLookup", "true")
                 .option("maxFilesPerTrigger", files).parquet(path))
    return TB.events_to_posts(feed, TB._nations(spark, d))


@register("stream_dedup", O.with_ctes(
    "SELECT platform, post_id, author, likes FROM posts_event", "posts_event"))
def q_stream_dedup(spark, d):
    """ST1: the events in several files, the whole table delivered twice; every
    post is stored once."""
    cols = ["platform", "post_id", "author", "likes", "crawl_time"]
    s = _event_feed(spark, d).select(*cols).unionByName(ST.event_posts_stream(spark, d).select(*cols))
    return spark.read.parquet(ST.run_dedup(s)).select("platform", "post_id", "author", "likes")


@register("stream_trend", ORACLE["sentiment_trend"])
def q_stream_trend(spark, d):
    """ST3: equals ``sentiment_trend`` (168 h) computed as a stream."""
    from datetime import timedelta
    out = ST.run_counts(ST.stream_trend(_event_feed(spark, d), AS_OF - timedelta(hours=168)), "trend", "hour")
    return ST.total_counts(spark, out, "hour").select("hour", "total", "positive", "negative")


@register("stream_surge", O.with_ctes("""
SELECT e.minute, CAST(SUM(m.n) AS BIGINT) AS total, CAST(SUM(m.neg) AS BIGINT) AS negative,
       round(SUM(m.neg) / SUM(m.n), 6) AS ratio
FROM (SELECT DISTINCT m + k * INTERVAL 1 MINUTE AS minute FROM mins, range(0, 60) r(k)) e
JOIN mins m ON m.m BETWEEN e.minute - INTERVAL 59 MINUTE AND e.minute
GROUP BY e.minute""", "posts_event", extra="""mins AS (
  SELECT date_trunc('minute', crawl_time) AS m, COUNT(*) AS n,
         COUNT(*) FILTER (WHERE sentiment = 0) AS neg
  FROM posts_event WHERE sentiment IS NOT NULL GROUP BY 1)"""))
def q_stream_surge(spark, d):
    """ST4: equals ``negative_surge_backtest`` on the stream's minute counts."""
    out = ST.run_counts(ST.stream_surge(_event_feed(spark, d)), "surge", "minute")
    r = ST.surge_windows(ST.total_counts(spark, out, "minute"), 60)
    return r.select("minute", "total", "negative",
                    F.round(F.col("negative") / F.col("total"), 6).alias("ratio"))


@register("live_feed", O.with_ctes("""
SELECT id, publish_time, sentiment FROM posts_event
ORDER BY publish_time DESC, id DESC LIMIT 200""", "posts_event"))
def q_live_feed(spark, d):
    """ST6: rolling buffer of the 200 newest posts fed by the events stream."""
    return spark.read.parquet(ST.live_feed(_event_feed(spark, d), 200))


@register("live_feed_filtered", O.with_ctes("""
SELECT id, publish_time, sentiment FROM posts_event WHERE platform = 'weibo' AND sentiment = 0
ORDER BY publish_time DESC, id DESC LIMIT 50""", "posts_event"))
def q_live_feed_filtered(spark, d):
    """the live feed of one platform and sentiment."""
    return spark.read.parquet(ST.live_feed(_event_feed(spark, d), 50, platform="weibo", sentiment=0))


# ----------------------------------------------------------------- scoring (M*)

from ..operators import score as SC  # noqa: E402


def _labelled(posts):
    """Posts of the documents with a quality label, used as the sentiment label.
    Training reads them several times, so ``posts`` should be a written table."""
    return posts.filter(F.col("sentiment").isNotNull()).select("id", "content", F.col("sentiment").alias("label"))


def _split(df):
    # Deterministic split on a hash of the id: 80 % train, 20 % test.
    h = F.abs(F.xxhash64("id")) % 10
    return df.filter(h < 8), df.filter(h >= 8)


@register("train_eval", scoped=True)
def q_train_eval(spark, d):
    """M3: train the default classifier on 80 % of the labelled posts, evaluate on the rest."""
    tr, te = _split(cut(_labelled(_D(spark, d))))
    return SC.evaluate(SC.train(tr), te)


@register("score_posts", scoped=True)
def q_score_posts(spark, d):
    """M1: every post scored by the classifier trained on the labelled posts."""
    posts = cut(_D(spark, d).select("id", "content", "sentiment"))
    model = SC.train(_labelled(posts))
    return SC.score_posts(posts.select("id", "content"), model).select("id", "sentiment", "sentiment_score")


@register("analyze_batch", scoped=True)
def q_analyze_batch(spark, d):
    """M4: pending posts scored and given keywords, merged into the posts table."""
    posts = cut(_D(spark, d))
    model = SC.train(_labelled(posts))
    out = SC.analyze_batch(posts, SC.model_scorer(model), 5)
    return out.select("id", "sentiment", "sentiment_score", "analyze_status", "keywords")


def _fixed_weights(texts):
    """A scorer of fixed weights: P(pos) from the text's length; a text of 7 mod 50
    characters is one it cannot take."""
    n = texts.str.len()
    if (n % 50 == 7).any():
        raise ValueError("unsupported length")
    pos = (n % 10) / 10.0
    return 1 - pos, pos


_FIXED = """CASE WHEN length(content) % 50 = 7 THEN NULL WHEN {p} > 1 - {p} THEN 1 ELSE 0 END AS sentiment,
       CASE WHEN length(content) % 50 = 7 THEN NULL ELSE round(greatest({p}, 1 - {p}), 4) END AS sentiment_score"""
_FIXED = _FIXED.replace("{p}", "((length(content) % 10) / 10.0::DOUBLE)")


@register("score_fixed", O.with_ctes(f"""
SELECT id, {_FIXED}, CASE WHEN length(content) % 50 = 7 THEN 2 ELSE 1 END AS analyze_status,
       CASE WHEN length(content) % 50 = 7 THEN 'ValueError: unsupported length' END AS error
FROM posts_doc""", "posts_doc"))
def q_score_fixed(spark, d):
    """M1: a plugged-in scorer over all posts; a text that it rejects fails alone."""
    s = SC.function_scorer(_fixed_weights)(_D(spark, d))
    return s.withColumn("sentiment_score", F.round(F.col("sentiment_score").cast("double"), 4))


@register("analyze_fixed", O.with_ctes(f"""
SELECT id, CASE WHEN analyze_status = 0 THEN s.sentiment ELSE p.sentiment END AS sentiment,
       CASE WHEN analyze_status = 0 THEN s.sentiment_score END AS sentiment_score,
       CASE WHEN analyze_status <> 0 THEN analyze_status WHEN length(content) % 50 = 7 THEN 2 ELSE 1 END AS analyze_status
FROM posts_doc p JOIN (SELECT id, {_FIXED} FROM posts_doc) s USING (id)""", "posts_doc"))
def q_analyze_fixed(spark, d):
    """M4 with the plugged-in scorer: pending posts scored, the others untouched."""
    out = SC.analyze_batch(_D(spark, d), SC.function_scorer(_fixed_weights), 5)
    return out.select("id", "sentiment", F.round(F.col("sentiment_score").cast("double"), 4).alias("sentiment_score"),
                      "analyze_status")


@register("decide", """
SELECT event_id AS id, CASE WHEN p > 1 - p THEN 1 ELSE 0 END AS sentiment, round(greatest(p, 1 - p), 4) AS sentiment_score
FROM (SELECT event_id, (user_id % 101) / 100.0::DOUBLE AS p FROM events)""")
def q_decide(spark, d):
    """M2: the decision step over probabilities taken from the events (ties included)."""
    p = (F.col("user_id") % 101) / 100.0
    x = TB.read(spark, d, "events").select(F.col("event_id").alias("id"), SC.decide(1 - p, p).alias("_d"))
    return x.select("id", "_d.sentiment", F.round(F.col("_d.sentiment_score").cast("double"), 4).alias("sentiment_score"))


@register("eval_fixed", O.with_ctes("""
SELECT (SELECT SUM(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / COUNT(*) FROM p a, p b WHERE a.y = 1 AND b.y = 0) AS auc,
       (SELECT avg(CASE WHEN c = y THEN 1.0 ELSE 0.0 END) FROM p) AS accuracy, (SELECT COUNT(*) FROM p) AS n_test""", "posts_doc", extra="""
p AS (SELECT sentiment AS y, (length(content) % 10) / 10.0::DOUBLE AS s,
             CASE WHEN (length(content) % 10) / 10.0::DOUBLE > 1 - (length(content) % 10) / 10.0::DOUBLE THEN 1 ELSE 0 END AS c
      FROM posts_doc WHERE sentiment IS NOT NULL)"""))
def q_eval_fixed(spark, d):
    """M3: area under ROC and accuracy of the scorer of fixed weights over all
    labelled posts, ties included."""
    p = (F.length("content") % 10) / 10.0
    pred = _labelled(_D(spark, d)).select("label", p.alias("score"), F.when(p > 1 - p, 1).otherwise(0).alias("prediction"))
    return SC.binary_metrics(pred)


# ------------------------------------------------------------- html pages

from ..sources import html as H  # noqa: E402


@register("extract_posts", r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS art FROM pages
           WHERE contains(html, '<article>')),
t AS (SELECT page_id, url, regexp_extract(art, '(?s)<h1>(.*?)</h1>', 1) AS h1,
             replace(regexp_replace(art, '(?s)^.*?</h1>', ''), '<p>', ' ') AS body FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(h1, '(?s)<[^>]*>', '', 'g'),
               '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS title,
             trim(regexp_replace(replace(replace(replace(replace(regexp_replace(body, '(?s)<[^>]*>', '', 'g'),
               '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text
      FROM t)
SELECT page_id, CAST(0 AS BIGINT) AS card, 'weibo' AS platform,
       concat('wb_', md5(concat('weibo_', '未知用户', '_', coalesce(nullif(text, ''), title)))) AS post_id,
       '未知用户' AS author, title, CAST(length(coalesce(nullif(text, ''), title)) AS INT) AS content_chars,
       CAST(0 AS INT) AS likes, url
FROM c WHERE text <> '' OR title <> ''""")
def q_extract_posts(spark, d):
    """Posts parsed from every raw page (article cards)."""
    pages = TB.spread(TB.read(spark, d, "pages"), "page_id")
    p = H.extract_posts(pages, AS_OF)
    return p.select("page_id", "card", "platform", "post_id", "author", "title",
                    F.length("content").alias("content_chars"), "likes", "url")


@register("stream_keyword", ORACLE["alert_keyword"])
def q_stream_keyword(spark, d):
    """ST7: sensitive-word alerts on the events stream for posts crawled in the
    last day before the fixed clock."""
    return spark.read.parquet(ST.run_append(
        ST.stream_keyword_alerts(_event_feed(spark, d), ["error", "purchase"], 24 * 60, AS_OF), "keyword")).drop("_epoch")


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _doc_feed(spark, d) -> DataFrame:
    """The documents as a file stream, a file at a time: one file or a folder of
    part files.  The path is a pattern that only ``documents.parquet`` fits: a
    stream over a plain path must be over a folder."""
    return (spark.readStream.schema(DOC_SCHEMA).option("maxFilesPerTrigger", 1)
                 .parquet(f"{d.rstrip('/')}/documents.parque[t]"))


@register("stream_score")
def q_stream_score(spark, d):
    """ST2: documents arriving as a file stream, scored and given keywords per
    micro-batch with the classifier trained on labelled posts."""
    model = SC.train(cut(_labelled(_D(spark, d))))
    posts = _doc_feed(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return spark.read.parquet(ST.run_scoring(posts, SC.model_scorer(model))).drop("_epoch")


@register("stream_score_fixed", O.with_ctes(f"""
SELECT id, {_FIXED}, CASE WHEN length(content) % 50 = 7 THEN 2 ELSE 1 END AS analyze_status FROM posts_event""", "posts_event"))
def q_stream_score_fixed(spark, d):
    """ST2 with the scorer of fixed weights: the events in several files, at
    least eight posts a batch."""
    posts = _event_feed(spark, d).select("id", "content")
    out = spark.read.parquet(ST.run_scoring(posts, SC.function_scorer(_fixed_weights), min_batch=8)).drop("_epoch")
    return out.select("id", "sentiment", F.round(F.col("sentiment_score").cast("double"), 4).alias("sentiment_score"), "analyze_status")


@register("stream_heartbeat_rows", """
SELECT 'stream_trend' AS module_name, 'healthy' AS status, COUNT(*) AS rows FROM events""")
def q_stream_heartbeat_rows(spark, d):
    """ST8: the beats of the trend stream over several files name every row once."""
    from datetime import timedelta
    hb, trend = ST.HeartbeatListener(), ST.stream_trend(_event_feed(spark, d), AS_OF - timedelta(hours=168))
    spark.streams.addListener(hb.listener)
    try:
        ST.run_counts(trend, "stream_trend", "hour")
        told = -1
        for _ in range(100):        # progress events arrive on the listener's own thread
            if hb.beats and len(hb.beats) == told:
                break
            told = len(hb.beats)
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(hb.listener)
    rows = F.get_json_object("metadata", "$.rows").cast("long")
    name = F.regexp_replace("module_name", "_[0-9a-f]{6}$", "")
    return (hb.frame(spark).groupBy(name.alias("module_name"), "status").agg(F.sum(rows).alias("rows")))


@register("stream_heartbeats")
def q_stream_heartbeats(spark, d):
    """ST8 + A11: heartbeats from the progress of the trend stream, folded to
    the latest state per module."""
    from datetime import timedelta
    hb = ST.HeartbeatListener()
    spark.streams.addListener(hb.listener)
    try:
        ST.run_counts(ST.stream_trend(ST.event_posts_stream(spark, d), AS_OF - timedelta(hours=168)),
                      "stream_trend", "hour")
        for _ in range(100):        # progress events arrive on the listener's own thread
            if hb.beats:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(hb.listener)
    return R.health_status(hb.frame(spark).select("module_name", "status", "ts"))


@register("stream_silence", _replay_sql(O.with_ctes("", "posts_event").removeprefix("WITH ").rstrip() + """,
hist AS (SELECT id, 'keyword_trigger' AS alert_type, CAST(NULL AS BIGINT) AS related_topic_id, publish_time AS created_at
         FROM posts_event WHERE contains(content, 'error') OR contains(content, 'purchase'))"""))
def q_stream_silence(spark, d):
    """ST5: keyword alerts from the events stream, created at publish time, with
    the silence state carried over several files."""
    def alerts(posts):
        return (posts.filter(AL.first_match(F.col("content"), ["error", "purchase"]).isNotNull())
                     .select("id", F.lit("keyword_trigger").alias("alert_type"),
                             F.lit(None).cast("long").alias("related_topic_id"), F.col("publish_time").alias("created_at")))

    path, _ = ST.run_silenced_alerts(alerts(_event_feed(spark, d)), REPLAY_HOURS)
    fired = spark.read.parquet(path).select("id", F.lit(False).alias("_quiet"))
    return (alerts(_E(spark, d)).join(fired, "id", "left")
            .select("id", "alert_type", "related_topic_id", F.coalesce("_quiet", F.lit(True)).alias("suppressed")))


# -------------------------------------------------------- dense vectors

from ..operators import vectors as VEC  # noqa: E402

_CLASSES = """classes AS (
  SELECT min(vec_id) AS uid, COUNT(*) AS mult, bool_or(vec_id % 50 = 0) AS asks, embedding::DOUBLE[] AS e
  FROM embeddings WHERE embedding IS NOT NULL GROUP BY embedding)"""


def _embedding_index(spark, d):
    """The index of all embeddings; rows whose id is divisible by 50 ask."""
    units = VEC.unit_vectors(TB.read(spark, d, "embeddings"))
    return VEC.build_index(VEC.classes_of(units, F.col("id") % 50 == 0)[0])


@register("embedding_pairs", f"""WITH {_CLASSES}
SELECT query_id, rank, vec_id, copies, round(s, 6) AS similarity
FROM (SELECT query_id, vec_id, copies, s, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INT) AS rank
      FROM (SELECT a.uid AS query_id, b.uid AS vec_id, b.mult AS copies, list_cosine_similarity(a.e, b.e) AS s
            FROM classes a JOIN classes b ON a.uid <> b.uid WHERE a.asks))
WHERE rank <= 10""", scoped=True)
def q_embedding_pairs(spark, d):
    """The ten nearest of all embeddings for every query (exact)."""
    r = VEC.exact_neighbours(_embedding_index(spark, d), 10)
    return r.select(F.col("qid").alias("query_id"), "rank", F.col("uid").alias("vec_id"), F.col("mult").alias("copies"),
                    F.round("cosine", 6).alias("similarity"))


@register("embedding_neighbours", scoped=True)
def q_embedding_neighbours(spark, d):
    """The ten nearest embeddings of every query from the nearest cells, as
    many as hold nine tenths of the true neighbours of sampled queries."""
    index = _embedding_index(spark, d)
    probes, recall = VEC.probes_for(index, 10)
    return (VEC.nearest_vectors(index, 10, probes)
            .select(F.col("qid").alias("query_id"), "rank", F.col("uid").alias("vec_id"), F.round("cosine", 6).alias("similarity"),
                    F.lit(probes).alias("probes"), F.lit(round(recall, 4)).alias("measured_recall")))


DENSE_T, DENSE_MIN = 0.4, 3


@register("embedding_clusters", f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON list_cosine_similarity(a.e, b.e) >= {DENSE_T}),
core AS (SELECT i FROM pairs GROUP BY i HAVING COUNT(*) >= {DENSE_MIN}),
links AS MATERIALIZED (SELECT p.i, p.j FROM pairs p WHERE p.i IN (FROM core) AND p.j IN (FROM core)),
reach(node, root) AS (SELECT i, i FROM core UNION SELECT l.j, r.root FROM reach r JOIN links l ON l.i = r.node),
comp AS (SELECT node, min(root) AS label FROM reach GROUP BY node)
SELECT node AS vec_id, label FROM comp
UNION ALL
SELECT p.j, min(c.label) FROM pairs p JOIN comp c ON c.node = p.i WHERE p.j NOT IN (FROM core) GROUP BY p.j""", scoped=True)
def q_embedding_clusters(spark, d):
    """C8 with C3: density clusters of all embeddings at cosine >= 0.4."""
    return (VEC.dense_clusters(TB.read(spark, d, "embeddings"), DENSE_T, DENSE_MIN)
            .select(F.col("id").alias("vec_id"), "label"))


# ------------------------------------------------ word lists of real size (J3, ST7)

# Every term of two posts or more is a sensitive word; rarer ones come first.
_WORD_LIST = "SELECT df AS pos, term AS word FROM vocab"


def _word_list(spark, d):
    return TF.vocabulary(TF.doc_freq(_D(spark, d))).select(F.col("df").alias("pos"), F.col("term").alias("word"))


@register("keyword_hits_many", O.with_ctes(f"""
SELECT p.id, min({{'pos': w.pos, 'word': w.word}}).word AS matched_word
FROM posts_doc p JOIN ({_WORD_LIST}) w ON contains(p.content, w.word)
GROUP BY p.id""", "posts_doc", extra=_TOKS), scoped=True)
def q_keyword_hits_many(spark, d):
    """J3 with the whole vocabulary of the posts as word list (thousands of
    words): the rarest word that each post holds, also inside other words."""
    return AL.keyword_hits(_D(spark, d), cut(_word_list(spark, d)))


@register("word_list_hits", O.with_ctes(f"""
SELECT w.word, COUNT(*) AS posts FROM posts_doc p JOIN ({_WORD_LIST}) w ON contains(p.content, w.word)
GROUP BY w.word""", "posts_doc", extra=_TOKS), scoped=True)
def q_word_list_hits(spark, d):
    """J2 with the whole vocabulary: the posts that hold each word."""
    from ..operators.words import word_matches
    found = word_matches(_D(spark, d).select("content"), cut(_word_list(spark, d)), "content")
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("posts"))


@register("stream_keyword_many", O.with_ctes(f"""
SELECT e.id, min({{'pos': w.pos, 'word': w.word}}).word AS matched_word
FROM posts_event e JOIN (SELECT pos, word FROM ({_WORD_LIST}) UNION ALL SELECT 0, 'error') w ON contains(e.content, w.word)
WHERE e.crawl_time >= TIMESTAMP '2024-01-29 12:00:00' GROUP BY e.id""", "posts_doc", "posts_event", extra=_TOKS), scoped=True)
def q_stream_keyword_many(spark, d):
    """ST7 on the events stream with the vocabulary of the posts and ``error``."""
    words = cut(_word_list(spark, d).unionByName(spark.createDataFrame([(0, "error")], "pos long, word string")))
    return spark.read.parquet(ST.run_keyword_alerts(_event_feed(spark, d), words, 24 * 60, AS_OF)).select("id", "matched_word")


# ------------------------------------------------- dictionary segmentation

from ..operators import segment as SG  # noqa: E402

_GRAMS = r"""r AS (SELECT run, COUNT(*) AS n FROM (
  SELECT unnest(regexp_split_to_array(lower(regexp_replace(coalesce(content, ''), '(\p{Han}+)', ' \1 ', 'g')), '[^\p{L}\p{N}]+')) AS run
  FROM posts_doc) WHERE run <> '' GROUP BY run),
g0 AS (SELECT run, n, unnest(range(1, length(run) + 1)) AS a FROM r),
g1 AS (SELECT run, n, a, unnest(range(1, least(7, length(run) - a + 2))) AS k FROM g0),
g AS (SELECT substr(run, a, k) AS gram, n, CASE WHEN a > 1 THEN substr(run, a - 1, 1) ELSE '' END AS lft, substr(run, a + k, 1) AS rgt FROM g1),
side AS (SELECT gram, 0 AS s, lft AS ch, sum(n) AS c FROM g GROUP BY gram, lft
         UNION ALL SELECT gram, 1, rgt, sum(n) FROM g GROUP BY gram, rgt),
ent AS (SELECT gram, s, sum(c) AS freq, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM side GROUP BY gram, s),
st AS (SELECT gram, max(freq) AS freq, min(h) AS entropy FROM ent GROUP BY gram),
able AS (SELECT * FROM st WHERE length(gram) > 1 AND freq >= 20 AND entropy >= 1.2),
cuts AS (SELECT gram, freq, unnest(range(1, length(gram))) AS k FROM able),
pm AS (SELECT c.gram, min(ln(c.freq * (SELECT sum(freq) FROM st WHERE length(gram) = 1) / a.freq / b.freq)) AS pmi
       FROM cuts c JOIN st a ON a.gram = substr(c.gram, 1, c.k) JOIN st b ON b.gram = substr(c.gram, c.k + 1) GROUP BY c.gram)"""


@register("dictionary_words", O.with_ctes("""
SELECT a.gram AS word, CAST(a.freq AS BIGINT) AS freq, round(p.pmi, 5) AS pmi, round(a.entropy, 5) AS entropy
FROM able a JOIN pm p ON p.gram = a.gram AND p.pmi >= 1.0
UNION ALL SELECT gram, CAST(freq AS BIGINT), NULL, round(entropy, 5) FROM st WHERE length(gram) = 1""", "posts_doc", extra=_GRAMS), scoped=True)
def q_dictionary_words(spark, d):
    """The dictionary learned from all posts."""
    words = SG.learn_dictionary(cut(SG.run_counts(_D(spark, d))))
    return words.select("word", "freq", F.round("pmi", 5).alias("pmi"), F.round("entropy", 5).alias("entropy"))


@register("tokens_dictionary", scoped=True)
def q_tokens_dictionary(spark, d):
    """The tokens of all posts along the best paths over the learned words."""
    return SG.dictionary_tokens(_D(spark, d))
