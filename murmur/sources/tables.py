"""Readers for the driver tables and the posts / topics / alerts views built on them.

The mappings follow FIXTURES.md: they only shape rows of the driver tables
into the schemas the jobs expect and do none of the jobs' work.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S

# The fixed clock of every test query (FIXTURES "Clock").
AS_OF = _dt.datetime(2024, 1, 30, 12, 0, 0)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give CPU-heavy per-row work (tokenising, hashing, parsing whole texts)
    at least one partition per core: hash-repartition on ``key`` only when the
    scan yields fewer splits than the default parallelism (a table written as
    one row group).  A large table already has many splits and is untouched.
    """
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001  (no RDD view, e.g. a remote session): leave the scan as is
        return df
    if splits < target:
        return df.repartition(target, key)
    return df


def _platform(user_id):
    return F.when(user_id % 5 < 3, F.lit("weibo")).otherwise(F.lit("xiaohongshu"))


def _nations(spark, sf_dir):
    # nation is a fixed 25-row dimension: broadcasting it is bounded by construction.
    return F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


def posts_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per document (text work: ingest, keywords, clustering, search).

    Events and labels meet by the document's number first, so that the texts
    take part in one join only."""
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    e = (read(spark, sf_dir, "events").filter(F.col("event_id") % 5 == 0)
         .select(F.expr("event_id div 5").alias("e_doc_id"), "ts", "user_id", "value")
         .join(_nations(spark, sf_dir), F.col("n_nationkey") == F.col("user_id") % 25))
    lab = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_doc_id"), "quality")
    j = d.join(e.join(lab, F.col("l_doc_id") == F.col("e_doc_id"), "left"), F.col("e_doc_id") == F.col("doc_id"))
    return j.select(
        F.col("doc_id").alias("id"),
        _platform(F.col("user_id")).alias("platform"),
        F.concat(F.lit("p_"), F.col("doc_id").cast("string")).alias("post_id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"),
        F.col("text").alias("content"),
        F.col("ts").alias("publish_time"),
        F.expr("timestampadd(MINUTE, CAST(doc_id % 30 AS INT), ts)").alias("crawl_time"),
        F.floor("value").cast("int").alias("likes"),
        F.col("n_name").alias("province"),
        F.col("quality").cast("int").alias("sentiment"),
        F.when(F.col("quality").isNull(), 0).otherwise(1).cast("int").alias("analyze_status"),
    )


def posts_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per event (volume work: trend, region, KPIs, surge, growth, streams)."""
    e = read(spark, sf_dir, "events")
    return events_to_posts(e, _nations(spark, sf_dir))


def events_to_posts(e: DataFrame, nations: DataFrame) -> DataFrame:
    """The posts_event mapping; shared by the batch reader and the file stream."""
    et = F.col("event_type")
    return (e.join(nations, F.col("n_nationkey") == F.col("user_id") % 25)
             .select(
                 F.col("event_id").alias("id"),
                 _platform(F.col("user_id")).alias("platform"),
                 F.concat(F.lit("e_"), F.col("event_id").cast("string")).alias("post_id"),
                 F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"),
                 F.concat(et, F.lit(" "), F.col("props")).alias("content"),
                 F.col("ts").alias("publish_time"),
                 F.expr("timestampadd(MINUTE, CAST(event_id % 30 AS INT), ts)").alias("crawl_time"),
                 F.floor("value").cast("int").alias("likes"),
                 F.col("n_name").alias("province"),
                 F.when(et.isin("purchase", "view"), 1).when(et.isin("error", "click"), 0)
                  .cast("int").alias("sentiment"),
                 F.when(et == "signup", 0).otherwise(1).cast("int").alias("analyze_status"),
                 (F.col("user_id") % 10).cast("long").alias("topic_id"),
             ))


def hot_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics table derived from posts_event grouped by topic_id."""
    p = posts_event(spark, sf_dir)
    return (p.groupBy("topic_id").agg(
                F.count(F.lit(1)).alias("post_count"),
                F.sum(F.when(F.col("sentiment") == 1, 1).otherwise(0)).alias("_pos"),
                F.count("sentiment").alias("_n"),
                F.avg("likes").alias("_avg_likes"),
                F.min("crawl_time").alias("first_seen"),
                F.max("crawl_time").alias("last_updated"))
             .select(
                 F.col("topic_id").alias("id"),
                 F.concat(F.lit("topic_"), F.col("topic_id").cast("string")).alias("topic_name"),
                 F.col("post_count"),
                 F.round(F.col("_pos") / F.col("_n"), 6).alias("sentiment_ratio"),
                 F.round(F.col("post_count") * (1 + F.col("_avg_likes") / 100.0), 6).alias("heat_score"),
                 "first_seen", "last_updated",
                 F.lit("active").alias("status")))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts table: one alert per error event."""
    e = read(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    m = F.col("event_id") % 3
    atype = F.when(m == 0, "negative_surge").when(m == 1, "keyword_trigger").otherwise("topic_growth")
    return e.select(
        F.col("event_id").alias("id"),
        atype.alias("alert_type"),
        F.when(m == 0, "info").when(m == 1, "warning").otherwise("critical").alias("severity"),
        F.concat(atype, F.lit(" "), F.col("event_id").cast("string")).alias("title"),
        F.col("props").alias("description"),
        F.when(m == 2, F.col("user_id") % 10).cast("long").alias("related_topic_id"),
        F.lit(None).cast("string").alias("trigger_data"),
        (F.col("event_id") % 2 == 0).alias("is_read"),
        F.lit(False).alias("notified"),
        F.col("ts").alias("created_at"),
    )


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("module_name"),
        F.when(F.col("event_type") == "error", "degraded").otherwise("healthy").alias("status"),
        F.col("ts").alias("ts"),
    )


# ---------------------------------------------------------------------------
# Seed configuration rows.
# The default alert rules and monitor keywords of the studied
# system, verbatim.
SEED_RULES = [
    (1, "Negative Surge", "negative_surge",
     '{"negativeRatioThreshold": 0.6, "minPostCount": 20, "windowHours": 1, '
     '"baselineHours": 6, "baselineThreshold": 0.3, "silenceHours": 24}', True),
    (2, "Keyword Trigger", "keyword_trigger",
     '{"sensitiveWords": ["暴雷", "跑路", "诈骗", "维权"], "silenceHours": 1}', True),
    (3, "Topic Growth", "topic_growth",
     '{"growthRateThreshold": 3.0, "windowHours": 24, "silenceHours": 48}', True),
]
SEED_KEYWORDS = [
    ("AI", "all", True),
    ("新能源", "all", True),
    ("就业", "all", True),
    ("人工智能", "all", True),
]


def rules_table(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows if rows is not None else SEED_RULES, S.ALERT_RULES)


def keywords_table(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows if rows is not None else SEED_KEYWORDS, S.MONITOR_KEYWORDS)
