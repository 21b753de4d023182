"""Scans, lookups, searches, pages and top-k listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefmt import hours_before, ts_lit


def paginate(df: DataFrame, order: list[Column], page: int = 1, size: int = 20) -> DataFrame:
    """One page of an ordered listing.

    ``orderBy + offset + limit`` plans as a bounded top-(offset+size)
    (TakeOrderedAndProject): each task keeps its own best rows, no full sort.
    """
    page = max(1, int(page))
    out = df.orderBy(*order)
    if page > 1:
        out = out.offset((page - 1) * size)
    return out.limit(size)


def by_id(df: DataFrame, id_value: int) -> DataFrame:
    """Point lookup; the equality reaches the Parquet reader as a pushed filter."""
    return df.filter(F.col("id") == F.lit(id_value))


def search_filter(posts: DataFrame, platform=None, sentiment=None, keyword=None,
                  start=None, end=None) -> DataFrame:
    """F1 predicate: ANDed optional filters; keyword match ignores case like the
    reference's case-insensitive collation; both time bounds inclusive."""
    cond = F.lit(True)
    if platform is not None:
        cond = cond & (F.col("platform") == platform)
    if sentiment is not None:
        cond = cond & (F.col("sentiment") == int(sentiment))
    if keyword is not None:
        cond = cond & F.lower(F.col("content")).contains(keyword.lower())
    if start is not None:
        cond = cond & (F.col("publish_time") >= ts_lit(start))
    if end is not None:
        cond = cond & (F.col("publish_time") <= ts_lit(end))
    return posts.filter(cond)


def search_posts(posts: DataFrame, platform=None, sentiment=None, keyword=None,
                 start=None, end=None, page: int = 1, size: int = 20, after=None) -> DataFrame:
    """F1 + P1: filtered posts, newest first (id breaks ties).

    ``after``: (publish_time, id) of the last row that the reader has; the
    listing goes on behind it, and a task holds ``size`` rows however deep the
    page is.  A page counted from the start begins at the key that ``key_at``
    finds from counts by hour, without a look at the pages before it.
    """
    f = search_filter(posts, platform, sentiment, keyword, start, end)
    newest = [F.col("publish_time").desc(), F.col("id").desc()]
    if int(page) > 1:
        first = key_at(_after(f, after), (int(page) - 1) * size)
        if first is None:
            return f.limit(0)
        return _after(f, first, inclusive=True).orderBy(*newest).limit(size)
    return _after(f, after).orderBy(*newest).limit(size)


def _after(posts: DataFrame, after, inclusive: bool = False) -> DataFrame:
    """The posts behind the key ``after`` (from it on), newest first; those
    without a publish time come last."""
    if after is None:
        return posts
    i = F.lit(int(after[1]))
    behind = (F.col("id") <= i) if inclusive else (F.col("id") < i)
    if after[0] is None:
        return posts.filter(F.col("publish_time").isNull() & behind)
    t = ts_lit(after[0])
    return posts.filter((F.col("publish_time") < t) | ((F.col("publish_time") == t) & behind) | F.col("publish_time").isNull())


SORTED = 100_000    # keys that are sorted to find one among them


def hour_counts(posts: DataFrame) -> DataFrame:
    """The page directory: (bucket, n), the posts of every hour of publish time.
    Cut to a table it serves any number of pages of one listing."""
    return _counts(posts, _LEVELS[0])


# The order (publish_time desc, id desc) as whole numbers, from coarse to fine.
_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', publish_time)"
_LEVELS = [f"{_MICROS} div 3600000000", f"{_MICROS} div 1000000", _MICROS, "id div 65536"]


def _counts(posts: DataFrame, level: str) -> DataFrame:
    return posts.groupBy(F.expr(level).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def key_at(posts: DataFrame, skip: int, directory: DataFrame | None = None, small: int = SORTED):
    """(publish_time, id) of the post that ``skip`` others come before, newest
    first, or None.  Counts by hour tell the hour it is in and its place there;
    an hour of more than ``small`` posts is counted by second, time and id range
    in turn, so only that many keys are ever sorted."""
    left, own = int(skip), posts.select("publish_time", "id")
    for k, level in enumerate(_LEVELS):
        counts = directory if k == 0 and directory is not None else _counts(own, level)
        newest = Window.orderBy(F.col("bucket").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)    # a row a bucket
        row = (counts.withColumn("upto", F.sum("n").over(newest)).filter(F.col("upto") > left)
                     .orderBy("upto").select("bucket", "n", "upto").limit(1).collect())
        if not row:
            return None
        bucket, n, upto = row[0]
        left -= upto - n
        own = own.filter(F.expr(level).cast("long").eqNullSafe(F.lit(bucket).cast("long")))
        if n <= small:
            break
    found = own.orderBy(F.col("publish_time").desc(), F.col("id").desc()).offset(left).limit(1).collect()
    return tuple(found[0]) if found else None


def pending(posts: DataFrame, limit: int = 64) -> DataFrame:
    """the oldest pending posts by id."""
    return posts.filter(F.col("analyze_status") == 0).orderBy("id").limit(limit)


def clusterable(posts: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """analysed posts crawled in the last ``hours``."""
    return posts.filter((F.col("crawl_time") >= hours_before(as_of, hours))
                        & (F.col("analyze_status") == 1) & F.col("sentiment").isNotNull())


def enabled(df: DataFrame) -> DataFrame:
    """enabled rules / keywords."""
    return df.filter(F.col("enabled"))


def feed_filter(df: DataFrame, platform=None, sentiment=None) -> DataFrame:
    """live-feed filter, usable on a batch or a streaming DataFrame."""
    cond = F.lit(True)
    if platform:
        cond = cond & (F.col("platform") == platform)
    if sentiment is not None:
        cond = cond & (F.col("sentiment") == int(sentiment))
    return df.filter(cond)


def list_alerts(alerts: DataFrame, severity=None, page: int = 1, size: int = 20) -> DataFrame:
    """alerts, optionally by severity, newest first."""
    f = alerts if severity is None else alerts.filter(F.col("severity") == severity)
    return paginate(f, [F.col("created_at").desc(), F.col("id").desc()], page, size)


def list_topics(topics: DataFrame, status=None, name_contains=None,
                page: int = 1, size: int = 20) -> DataFrame:
    """topics, optionally by status and a name substring, hottest first."""
    f = topics if status is None else topics.filter(F.col("status") == status)
    if name_contains:
        f = f.filter(F.lower(F.col("topic_name")).contains(name_contains.lower()))
    return paginate(f, [F.col("heat_score").desc(), F.col("id")], page, size)


def top_topics(topics: DataFrame, limit: int = 10) -> DataFrame:
    """The hottest active topics."""
    return (topics.filter(F.col("status") == "active")
                  .orderBy(F.col("heat_score").desc(), F.col("id")).limit(limit))


def recent_alerts(alerts: DataFrame, limit: int = 10) -> DataFrame:
    """The newest alerts."""
    return alerts.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def topic_rank(topics: DataFrame, limit: int = 10) -> DataFrame:
    """Rank 1..n by heat among the top ``limit`` topics and a top-3 flag.

    The window runs after the limit, so its single partition holds at most
    ``limit`` rows whatever the table size.
    """
    top = top_topics(topics, limit)
    w = Window.orderBy(F.col("heat_score").desc(), F.col("id"))
    return (top.withColumn("rank", F.row_number().over(w).cast("long"))
               .withColumn("top3", F.col("rank") <= 3))


def present_topics(topics: DataFrame) -> DataFrame:
    """F8: display fields of a topic: rounded heat, positive percent, colour flag."""
    ratio = F.coalesce(F.col("sentiment_ratio"), F.lit(0.0))
    return topics.select(
        "id", "topic_name", "heat_score",
        F.when(ratio > 0.5, "positive").otherwise("negative").alias("heat_label"),
        F.round(ratio * 100.0, 1).alias("positive_pct"),
        F.round(F.coalesce(F.col("heat_score"), F.lit(0.0)), 0).alias("heat_display"),
    )


def present_posts(posts: DataFrame) -> DataFrame:
    """Display fields of a post: 100-character preview, month-day-hour
    and hour text of its publish time, sentiment label."""
    t = F.date_format("publish_time", "yyyy-MM-dd HH:mm:ss")
    return posts.select(
        "id", F.substring("content", 1, 100).alias("preview"),
        F.substring(t, 6, 11).alias("short_time"), F.substring(t, 12, 5).alias("hour_time"),
        F.when(F.col("sentiment") == 1, "positive").when(F.col("sentiment") == 0, "negative")
         .otherwise("pending").alias("label"))


def mark_all_read(alerts: DataFrame) -> DataFrame:
    """Every alert read afterwards; ``changed`` marks the rows the update touched."""
    return alerts.select("id", F.lit(True).alias("is_read"),
                         (~F.coalesce(F.col("is_read"), F.lit(False))).alias("changed"))


def mark_read(alerts: DataFrame, alert_id: int) -> DataFrame:
    """One alert marked read."""
    return alerts.withColumn("is_read", F.when(F.col("id") == alert_id, F.lit(True))
                                         .otherwise(F.col("is_read")))


def cool_topics(topics: DataFrame, as_of, idle_hours: int = 48) -> DataFrame:
    """Active topics idle for ``idle_hours`` become cold (archived is never set)."""
    cutoff = hours_before(as_of, idle_hours)
    return topics.withColumn(
        "status", F.when((F.col("status") == "active") & (F.col("last_updated") < cutoff), "cold")
                   .otherwise(F.col("status")))


def topic_posts(topics: DataFrame, posts: DataFrame, per_topic: int = 50) -> DataFrame:
    """Every topic with its latest ``per_topic`` posts, all topics at once.

    ``row_number() <= k`` is planned with a map-side WindowGroupLimit, so a
    hot topic ships at most k rows per map task to its reducer.
    """
    w = Window.partitionBy("topic_id").orderBy(F.col("publish_time").desc(), F.col("id").desc())
    ranked = (posts.filter(F.col("topic_id").isNotNull())
                   .select("topic_id", "id", "publish_time")
                   .withColumn("rn", F.row_number().over(w))
                   .filter(F.col("rn") <= per_topic))
    t = topics.select(F.col("id").alias("topic_id"))
    return ranked.join(t, "topic_id", "left_semi").withColumn("rn", F.col("rn").cast("long"))
