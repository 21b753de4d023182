"""Declared schemas of the data model (no inference anywhere)."""

from pyspark.sql import types as T

POSTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("platform", T.StringType(), False),
    T.StructField("post_id", T.StringType(), False),
    T.StructField("author", T.StringType(), True),
    T.StructField("content", T.StringType(), False),
    T.StructField("publish_time", T.TimestampNTZType(), False),
    T.StructField("likes", T.IntegerType(), True),
    T.StructField("comments", T.IntegerType(), True),
    T.StructField("shares", T.IntegerType(), True),
    T.StructField("url", T.StringType(), True),
    T.StructField("province", T.StringType(), True),
    T.StructField("city", T.StringType(), True),
    T.StructField("sentiment", T.IntegerType(), True),
    T.StructField("sentiment_score", T.FloatType(), True),
    T.StructField("topic_id", T.LongType(), True),
    T.StructField("keywords", T.ArrayType(T.StringType()), True),
    T.StructField("analyze_status", T.IntegerType(), False),
    T.StructField("crawl_time", T.TimestampNTZType(), True),
])

HOT_TOPICS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("topic_name", T.StringType(), False),
    T.StructField("keywords", T.ArrayType(T.StringType()), True),
    T.StructField("post_count", T.LongType(), True),
    T.StructField("sentiment_ratio", T.DoubleType(), True),
    T.StructField("heat_score", T.DoubleType(), True),
    T.StructField("first_seen", T.TimestampNTZType(), True),
    T.StructField("last_updated", T.TimestampNTZType(), True),
    T.StructField("status", T.StringType(), True),
])

ALERTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("alert_type", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("related_topic_id", T.LongType(), True),
    T.StructField("trigger_data", T.StringType(), True),
    T.StructField("is_read", T.BooleanType(), True),
    T.StructField("notified", T.BooleanType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

HEARTBEATS = T.StructType([
    T.StructField("module_name", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
])

MONITOR_KEYWORDS = T.StructType([
    T.StructField("keyword", T.StringType(), False),
    T.StructField("platform", T.StringType(), False),
    T.StructField("enabled", T.BooleanType(), False),
])

ALERT_RULES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("rule_name", T.StringType(), False),
    T.StructField("rule_type", T.StringType(), False),
    T.StructField("config", T.StringType(), False),
    T.StructField("enabled", T.BooleanType(), False),
])

# from_json schemas, one per rule type
NEGATIVE_SURGE_CONFIG = T.StructType([
    T.StructField("negativeRatioThreshold", T.DoubleType()),
    T.StructField("minPostCount", T.IntegerType()),
    T.StructField("windowHours", T.IntegerType()),
    T.StructField("baselineHours", T.IntegerType()),
    T.StructField("baselineThreshold", T.DoubleType()),
    T.StructField("silenceHours", T.IntegerType()),
])
KEYWORD_TRIGGER_CONFIG = T.StructType([
    T.StructField("sensitiveWords", T.ArrayType(T.StringType())),
    T.StructField("silenceHours", T.IntegerType()),
])
TOPIC_GROWTH_CONFIG = T.StructType([
    T.StructField("growthRateThreshold", T.DoubleType()),
    T.StructField("windowHours", T.IntegerType()),
    T.StructField("silenceHours", T.IntegerType()),
])
RULE_CONFIGS = {
    "negative_surge": NEGATIVE_SURGE_CONFIG,
    "keyword_trigger": KEYWORD_TRIGGER_CONFIG,
    "topic_growth": TOPIC_GROWTH_CONFIG,
}
