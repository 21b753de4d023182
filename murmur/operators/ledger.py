"""Which post belongs to which topic, over repeated runs.

Runs over a sliding day see most posts again.  The ledger records what a run
changes: +1 for a post that enters a topic, -1 for one that leaves it; a post
seen again in the same topic leaves no row.  A row carries what the post adds
to its topic's figures at that time, and a leaving row takes away exactly what
the entering one had added, so the totals of a topic are sums over its rows
and count every linked post once, however often it was clustered.  A changed
post (new likes, a sentiment) leaves and enters anew.  A run meets the ledger
only through the open links, which ``fold`` reduces to one row a post."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "id long, topic_id long, run long, d int, positive int, likes long"
_VALUES = ["topic_id", "positive", "likes"]


def open_links(ledger: DataFrame) -> DataFrame:
    """(id, topic_id, positive, likes): the post's present link."""
    return (ledger.groupBy("id", *_VALUES).agg(F.sum("d").alias("n")).filter("n > 0").select("id", *_VALUES))


def link_changes(ledger: DataFrame, links: DataFrame, run: int) -> DataFrame:
    """The ledger rows that ``links`` (id, topic_id, sentiment, likes: the posts
    that this run put into a topic, each once) adds.  Posts that the run did
    not link keep their topic."""
    new = links.select("id", F.col("topic_id").alias("_topic"), F.coalesce((F.col("sentiment") == 1).cast("int"), F.lit(0)).alias("_positive"),
                       F.coalesce("likes", F.lit(0)).cast("long").alias("_likes"))
    both = new.join(open_links(ledger), "id", "left")
    changed = both.filter(F.col("topic_id").isNull() | (F.col("topic_id") != F.col("_topic"))
                          | (F.col("positive") != F.col("_positive")) | (F.col("likes") != F.col("_likes")))
    row = lambda topic, d, positive, likes: F.struct(F.col(topic).alias("topic_id"), F.lit(run).cast("long").alias("run"),
                                                     F.lit(d).alias("d"), F.col(positive).alias("positive"), F.col(likes).alias("likes"))
    return (changed.select("id", F.explode(F.array(row("topic_id", -1, "positive", "likes"), row("_topic", 1, "_positive", "_likes"))).alias("r"))
            .select("id", "r.*").filter("topic_id IS NOT NULL"))


def fold(ledger: DataFrame) -> DataFrame:
    """The ledger as its open links only (one row a post), dated with the last run."""
    run = ledger.groupBy("id").agg(F.max("run").alias("run"))
    return open_links(ledger).join(run, "id").select("id", "topic_id", "run", F.lit(1).alias("d"), "positive", "likes")


def topic_totals(ledger: DataFrame) -> DataFrame:
    """(topic_id, post_count, sentiment_ratio, heat_score) of the distinct posts
    linked now (A7's formulas): sums of signed rows, combined map-side."""
    n = F.sum("d")
    return (ledger.groupBy("topic_id")
            .agg(n.cast("long").alias("post_count"), (F.sum(F.col("d") * F.col("positive")) / n).alias("sentiment_ratio"),
                 (n * (1 + F.sum(F.col("d") * F.col("likes")) / n / 100)).alias("heat_score"))
            .filter("post_count > 0"))


def with_totals(topics: DataFrame, ledger: DataFrame) -> DataFrame:
    """``topics`` (as ``merge_topics`` returns them) with count, ratio and heat of
    their linked posts; topics that never had a link keep their figures, those
    that lost all of them have a count of 0."""
    had = ledger.select("topic_id").distinct()
    own = had.join(topic_totals(ledger), "topic_id", "left").select(
        F.col("topic_id").alias("id"), F.lit(True).alias("_had"), F.coalesce("post_count", F.lit(0)).cast("long").alias("_post_count"),
        F.col("sentiment_ratio").alias("_sentiment_ratio"), F.col("heat_score").alias("_heat_score"))
    new = {c: F.when(F.col("_had"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("post_count", "sentiment_ratio", "heat_score")}
    return topics.join(own, "id", "left").select(*[new.get(c, F.col(c)) for c in topics.columns])
