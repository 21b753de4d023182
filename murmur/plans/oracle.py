"""DuckDB SQL for the independent oracle.

Each query repeats the FIXTURES mappings as CTEs over the pre-registered
driver tables, then states the operator in plain SQL.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-30 12:00:00'"

POSTS_DOC = """posts_doc AS (
  SELECT d.doc_id AS id,
         CASE WHEN e.user_id % 5 < 3 THEN 'weibo' ELSE 'xiaohongshu' END AS platform,
         concat('p_', CAST(d.doc_id AS VARCHAR)) AS post_id,
         concat('user', CAST(e.user_id AS VARCHAR)) AS author,
         d.text AS content,
         e.ts AS publish_time,
         e.ts + (d.doc_id % 30) * INTERVAL '1' MINUTE AS crawl_time,
         CAST(floor(e.value) AS INT) AS likes,
         n.n_name AS province,
         l.quality AS sentiment,
         CAST(CASE WHEN l.quality IS NULL THEN 0 ELSE 1 END AS INT) AS analyze_status
  FROM documents d
  JOIN events e ON e.event_id = d.doc_id * 5
  JOIN nation n ON n.n_nationkey = e.user_id % 25
  LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

POSTS_EVENT = """posts_event AS (
  SELECT e.event_id AS id,
         CASE WHEN e.user_id % 5 < 3 THEN 'weibo' ELSE 'xiaohongshu' END AS platform,
         concat('e_', CAST(e.event_id AS VARCHAR)) AS post_id,
         concat('user', CAST(e.user_id AS VARCHAR)) AS author,
         concat(e.event_type, ' ', e.props) AS content,
         e.ts AS publish_time,
         e.ts + (e.event_id % 30) * INTERVAL '1' MINUTE AS crawl_time,
         CAST(floor(e.value) AS INT) AS likes,
         n.n_name AS province,
         CAST(CASE WHEN e.event_type IN ('purchase', 'view') THEN 1
                   WHEN e.event_type IN ('error', 'click') THEN 0 END AS INT) AS sentiment,
         CAST(CASE WHEN e.event_type = 'signup' THEN 0 ELSE 1 END AS INT) AS analyze_status,
         CAST(e.user_id % 10 AS BIGINT) AS topic_id
  FROM events e
  JOIN nation n ON n.n_nationkey = e.user_id % 25)"""

HOT_TOPICS = """hot_topics AS (
  SELECT topic_id AS id,
         concat('topic_', CAST(topic_id AS VARCHAR)) AS topic_name,
         COUNT(*) AS post_count,
         round(SUM(CASE WHEN sentiment = 1 THEN 1 ELSE 0 END) / COUNT(sentiment), 6) AS sentiment_ratio,
         round(COUNT(*) * (1 + avg(likes) / 100.0), 6) AS heat_score,
         min(crawl_time) AS first_seen,
         max(crawl_time) AS last_updated,
         'active' AS status
  FROM posts_event GROUP BY topic_id)"""

ALERTS = """alerts AS (
  SELECT event_id AS id,
         CASE event_id % 3 WHEN 0 THEN 'negative_surge' WHEN 1 THEN 'keyword_trigger'
              ELSE 'topic_growth' END AS alert_type,
         CASE event_id % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'critical' END AS severity,
         concat(CASE event_id % 3 WHEN 0 THEN 'negative_surge' WHEN 1 THEN 'keyword_trigger'
                ELSE 'topic_growth' END, ' ', CAST(event_id AS VARCHAR)) AS title,
         props AS description,
         CASE WHEN event_id % 3 = 2 THEN CAST(user_id % 10 AS BIGINT) END AS related_topic_id,
         (event_id % 2 = 0) AS is_read,
         ts AS created_at
  FROM events WHERE event_type = 'error')"""

HEARTBEATS = """heartbeats AS (
  SELECT concat('m', CAST(user_id % 4 AS VARCHAR)) AS module_name,
         CASE WHEN event_type = 'error' THEN 'degraded' ELSE 'healthy' END AS status,
         ts
  FROM events)"""

_CTES = {"posts_doc": POSTS_DOC, "posts_event": POSTS_EVENT, "hot_topics": HOT_TOPICS,
         "alerts": ALERTS, "heartbeats": HEARTBEATS}
_DEPENDS = {"hot_topics": ["posts_event"]}


def with_ctes(body: str, *names: str, extra: str | None = None) -> str:
    """Prefix ``body`` with the mapping CTEs it names (dependencies first)."""
    order: list[str] = []
    for n in names:
        for dep in _DEPENDS.get(n, []):
            if dep not in order:
                order.append(dep)
        if n not in order:
            order.append(n)
    parts = [_CTES[n] for n in order]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n" + body
