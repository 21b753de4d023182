"""Reports: trend, region, platform, KPIs, ratios, growth, health.

All of them are single-pass conditional aggregates: Spark runs a partial
HashAggregate before the shuffle, so a hot key costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import day_range, hour_text, hours_before


def _cnt(cond):
    return F.count_if(cond).cast("long")


def sentiment_trend(posts: DataFrame, hours: int, as_of) -> DataFrame:
    """A1: hourly total/positive/negative of analysed posts since ``as_of - hours``."""
    start = hours_before(as_of, hours)
    return (posts.filter((F.col("publish_time") >= start) & F.col("sentiment").isNotNull())
                 .groupBy(hour_text(F.col("publish_time")).alias("hour"))
                 .agg(F.count(F.lit(1)).alias("total"),
                      _cnt(F.col("sentiment") == 1).alias("positive"),
                      _cnt(F.col("sentiment") == 0).alias("negative"))
                 .orderBy("hour"))


def region_stats(posts: DataFrame, hours: int, as_of) -> DataFrame:
    """A2: per province, analysed posts and positives since ``as_of - hours``."""
    start = hours_before(as_of, hours)
    return (posts.filter(F.col("province").isNotNull() & F.col("sentiment").isNotNull()
                         & (F.col("publish_time") >= start))
                 .groupBy("province")
                 .agg(F.count(F.lit(1)).alias("total"),
                      _cnt(F.col("sentiment") == 1).alias("positive")))


def platform_stats(posts: DataFrame, hours: int, as_of) -> DataFrame:
    """A3: posts per platform since ``as_of - hours``."""
    start = hours_before(as_of, hours)
    return (posts.filter(F.col("publish_time") >= start)
                 .groupBy("platform").agg(F.count(F.lit(1)).alias("total")))


def dashboard_stats(posts: DataFrame, alerts: DataFrame, as_of) -> DataFrame:
    """A4/A5: the KPI row in one pass over posts and alerts (no join, no repeated scan).

    "Today" is the half-open day of ``as_of`` on crawl_time, so the predicate
    prunes Parquet row groups instead of wrapping the column in DATE().
    """
    d0, d1 = day_range(as_of)
    p = posts.select(F.lit(1).alias("src"), "crawl_time", "analyze_status", "sentiment",
                     F.lit(None).cast("boolean").alias("is_read"))
    a = alerts.select(F.lit(2).alias("src"), F.lit(None).cast("timestamp_ntz").alias("crawl_time"),
                      F.lit(None).cast("int").alias("analyze_status"),
                      F.lit(None).cast("int").alias("sentiment"), "is_read")
    today = (F.col("src") == 1) & (F.col("crawl_time") >= d0) & (F.col("crawl_time") < d1)
    return p.unionByName(a).agg(
        _cnt(today).alias("today_count"),
        _cnt((F.col("src") == 1) & (F.col("analyze_status") == 0)).alias("pending_count"),
        _cnt((F.col("src") == 2) & ~F.col("is_read")).alias("unread_alerts"),
        _cnt(today & (F.col("sentiment") == 1)).alias("positive"),
        _cnt(today & (F.col("sentiment") == 0)).alias("negative"),
    )


def negative_ratio(posts: DataFrame, hours: int, as_of) -> DataFrame:
    """Analysed and negative posts crawled since ``as_of - hours`` and their ratio."""
    start = hours_before(as_of, hours)
    agg = (posts.filter(F.col("crawl_time") >= start)
                .agg(_cnt(F.col("sentiment").isNotNull()).alias("total"),
                     _cnt(F.col("sentiment") == 0).alias("negative")))
    return agg.withColumn(
        "ratio", F.when(F.col("total") > 0, F.round(F.col("negative") / F.col("total"), 6)))


def topic_growth(topics: DataFrame, posts: DataFrame, hours: int, as_of,
                 min_previous: int = 5, equal_window: bool = False) -> DataFrame:
    """Per active topic, posts crawled since the cutoff vs all earlier posts
    (``equal_window``: vs those of the window of ``hours`` before the cutoff).

    Posts are pre-aggregated per topic before meeting the (much smaller)
    topics table, replacing the reference's two COUNT queries per topic.
    """
    cutoff = hours_before(as_of, hours)
    posts = posts.filter(F.col("crawl_time") >= hours_before(as_of, 2 * hours)) if equal_window else posts
    counts = (posts.filter(F.col("topic_id").isNotNull())
                   .groupBy("topic_id")
                   .agg(_cnt(F.col("crawl_time") >= cutoff).alias("current_count"),
                        _cnt(F.col("crawl_time") < cutoff).alias("previous_count")))
    t = (topics.filter((F.col("status") == "active") & (F.col("last_updated") >= cutoff)
                       & F.col("first_seen").isNotNull())
               .select(F.col("id").alias("topic_id"), "topic_name"))
    return (t.join(counts, "topic_id")
             .filter(F.col("previous_count") >= min_previous)
             .withColumn("growth", F.col("current_count") / F.col("previous_count")))


def health_status(heartbeats: DataFrame) -> DataFrame:
    """Fold heartbeats into the latest state per module.

    ``last_success`` is the latest healthy beat (default); the latest beat of
    any kind decides ``status`` (of one time, the largest status text).
    """
    return (heartbeats.groupBy("module_name")
                      .agg(F.max_by("status", F.struct("ts", "status")).alias("status"),
                           F.max(F.when(F.col("status") == "healthy", F.col("ts"))).alias("last_success"),
                           F.max("ts").alias("last_heartbeat")))


def page_info(filtered: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """Total, number of pages, current page for a filtered listing."""
    return (filtered.agg(F.count(F.lit(1)).alias("total"))
                    .select("total",
                            F.ceil(F.col("total") / F.lit(size)).cast("long").alias("pages"),
                            F.lit(page).cast("long").alias("current")))
