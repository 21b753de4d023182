"""Ingest: insert-ignore, upsert, defaults, ids, write, before/after counts.

Duplicate keys inside a batch are resolved with ``min_by``/``max_by``
aggregates, which combine map-side: a key repeated in a third of the batch
still reaches its reducer as one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import ts_lit
from ..session import cut

KEY = ["platform", "post_id"]
# Defaults the collectors filled in for missing fields.
DEFAULT_AUTHOR = {"weibo": "未知用户", "xiaohongshu": "小红书用户"}
UNKNOWN_PLACE = "未知"
CONTENT_ID_PREFIX = "wb_"
NOTE_ID_PATTERN = r"^[a-f0-9]{24}$"


def _prepared(existing: DataFrame | None, incoming: DataFrame, as_of) -> DataFrame:
    """A missing crawl time becomes ``as_of``; new rows have status 0."""
    if as_of is not None and "crawl_time" in incoming.columns:
        incoming = incoming.withColumn("crawl_time", F.coalesce(F.col("crawl_time"), ts_lit(as_of)))
    if existing is not None and "analyze_status" in existing.columns and "analyze_status" not in incoming.columns:
        incoming = incoming.withColumn("analyze_status", F.lit(0))
    return incoming


def _total_order(df: DataFrame, order: list[str]) -> Column:
    """``order``, then every other column by name: rows that tie are equal."""
    rest = sorted(c for c in df.columns if c not in KEY and c not in order)
    return F.struct(*order, *rest)


def ingest_ignore(existing: DataFrame, incoming: DataFrame, as_of=None,
                  order: list[str] | None = None) -> DataFrame:
    """S3 + S12: keep unseen ``(platform, post_id)`` keys of the batch, first
    write wins (earliest ``order``, ties by the other columns), known keys
    dropped; new rows get status 0 and a default crawl time.  The batch is
    reduced and written once; the stored table only meets the batch's keys,
    which Spark broadcasts when the written table is small."""
    return existing.unionByName(new_posts(existing, incoming, as_of, order), allowMissingColumns=True)


def first_rows(existing: DataFrame | None, incoming: DataFrame, as_of=None, order: list[str] | None = None) -> DataFrame:
    """The batch reduced to the first row of each key, written once."""
    inc = _prepared(existing, incoming, as_of)
    cols = [c for c in inc.columns if c not in KEY]
    return cut(inc.groupBy(*KEY).agg(F.min_by(F.struct(*cols), _total_order(inc, order or ["crawl_time"])).alias("_r"))
                  .select(*KEY, "_r.*").select(*inc.columns))


def new_posts(existing: DataFrame, incoming: DataFrame, as_of=None, order: list[str] | None = None) -> DataFrame:
    """The rows that ``ingest_ignore`` adds."""
    firsts = first_rows(existing, incoming, as_of, order)
    known = existing.select(*KEY).join(firsts.select(*KEY), KEY, "left_semi")
    return firsts.join(known, KEY, "left_anti")


def ingest_upsert(existing: DataFrame, incoming: DataFrame, update=("likes",), as_of=None,
                  order: list[str] | None = None) -> DataFrame:
    """Unseen keys are inserted (first row of the batch); for every key the
    ``update`` columns take the batch's last value (later duplicates overwrite).
    Ties in ``order`` are broken by the other columns."""
    update = list(update)
    inc = _prepared(existing, incoming, as_of)
    cols = [c for c in inc.columns if c not in KEY]
    ordk = _total_order(inc, order or ["crawl_time"])
    inc = cut(inc.groupBy(*KEY).agg(F.min_by(F.struct(*cols), ordk).alias("_first"),
                                    F.max_by(F.struct(*update), ordk).alias("_last")))
    last = inc.select(*KEY, "_last")
    updated = existing.join(last, KEY, "left").select(*[
        F.coalesce(F.col(f"_last.{c}"), F.col(c)).alias(c) if c in update else F.col(c) for c in existing.columns])
    known = existing.select(*KEY).join(last.select(*KEY), KEY, "left_semi")
    new = inc.join(known, KEY, "left_anti").select(*[
        F.col(c) if c in KEY else
        F.col(f"_last.{c}").alias(c) if c in update else
        F.col(f"_first.{c}").alias(c) if c in cols else
        F.lit(None).cast(existing.schema[c].dataType).alias(c)
        for c in existing.columns])
    return updated.unionByName(new)


def with_defaults(df: DataFrame) -> DataFrame:
    """Blank author -> platform default; blank content -> title; unknown
    place; missing counters -> 0."""
    def blank(c):
        return F.nullif(F.trim(F.col(c)), F.lit(""))
    plat_default = F.when(F.col("platform") == "xiaohongshu", DEFAULT_AUTHOR["xiaohongshu"]) \
                    .otherwise(DEFAULT_AUTHOR["weibo"])
    out = df.withColumn("author", F.coalesce(blank("author"), plat_default))
    if "title" in df.columns:
        out = out.withColumn("content", F.coalesce(blank("content"), F.col("title")))
    for c in ("province", "city"):
        if c in df.columns:
            out = out.withColumn(c, F.coalesce(blank(c), F.lit(UNKNOWN_PLACE)))
    for c in ("likes", "comments", "shares"):
        if c in df.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    return out


def content_id(author: Column, text: Column, platform: str = "weibo") -> Column:
    """``wb_`` + md5 of ``{platform}_{author}_{text}`` (UTF-8)."""
    return F.concat(F.lit(CONTENT_ID_PREFIX),
                    F.md5(F.concat(F.lit(platform + "_"), author, F.lit("_"), text)))


def note_id(url: Column) -> Column:
    """Last path segment of 24 hex digits (query string removed), else a
    stable md5 of the URL (the original used a per-process salted hash)."""
    base = F.split(url, r"\?").getItem(0)
    segs = F.filter(F.split(base, "/"), lambda p: p.rlike(NOTE_ID_PATTERN))
    return F.when(F.size(segs) > 0, F.element_at(segs, -1)).otherwise(F.md5(url))


def write_posts(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append posts partitioned by crawl date; Spark's commit protocol
    replaces the 500-row JDBC batches."""
    (df.withColumn("crawl_date", F.to_date("crawl_time"))
       .write.mode(mode).partitionBy("crawl_date").parquet(path))


def ingest_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Posts per platform before and after an ingest run, and the difference."""
    b = before.groupBy("platform").agg(F.count(F.lit(1)).alias("before"))
    a = after.groupBy("platform").agg(F.count(F.lit(1)).alias("after"))
    return (b.join(a, "platform", "full_outer")
             .select("platform",
                     F.coalesce("before", F.lit(0)).cast("long").alias("before"),
                     F.coalesce("after", F.lit(0)).cast("long").alias("after"))
             .withColumn("saved", F.col("after") - F.col("before")))
