"""Structured Streaming twins of the batch operators (ST1-ST8).

Sources are file streams; sinks write to the shared checkpoint folder (never
the driver's memory) through ``foreachBatch``, one folder per epoch, so a
retried epoch overwrites its own output.  Every job takes ``out`` (its results
and state) and ``checkpoint``: a second call with both goes on where the first
stopped; without them a call is a run of its own under a fresh folder.

Late rows are not lost: trend and surge keep additive counts per epoch (folded
into one table every COMPACT epochs), deduplication asks the stored keys.  The
silence of alerts is Spark's own keyed state with timers.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timefmt import ts_lit
from ..session import path_exists, scratch_path
from ..sources.tables import _nations, events_to_posts

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def _paths(spark: SparkSession, name: str, out: str | None, checkpoint: str | None) -> tuple[str, str]:
    """(out, checkpoint); a checkpoint without an output folder (or the other
    way round) could not go on with what an earlier run left."""
    if (out is None) != (checkpoint is None):
        raise ValueError("give both out and checkpoint, or neither")
    if out is None:
        base = scratch_path(spark, f"stream-{name}")
        return base + "/out", base + "/checkpoint"
    return out.rstrip("/"), checkpoint


COMPACT = 16    # epochs of counts that are folded into one table


def _run(df: DataFrame, name: str, sink, checkpoint: str, mode: str = "append", every: str | None = None):
    """Feed everything that has arrived to ``sink(batch, epoch)``; the query,
    which has ended.  ``every`` (such as ``30 seconds``): go on with a batch at
    that interval; the query, which runs until it is stopped."""
    def persisted(batch: DataFrame, epoch: int):
        batch = batch.persist()
        try:
            sink(batch, epoch)
        finally:
            batch.unpersist()

    w = (df.writeStream.queryName(f"{name}_{uuid.uuid4().hex[:6]}").outputMode(mode).foreachBatch(persisted)
           .option("checkpointLocation", checkpoint))
    if every is not None:
        return w.trigger(processingTime=every).start()
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _epochs(spark: SparkSession, out: str) -> list[int]:
    """The epochs that have a folder ``_epoch=N`` in ``out``, ascending.  A folder that
    is not there yet is empty; any other failure is the caller's."""
    if not path_exists(spark, out):
        return []
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(out)
    names = [f.getPath().getName() for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(int(m.group(1)) for n in names if (m := re.fullmatch(r"_epoch=(\d+)", n)))


def _before(spark: SparkSession, out: str, epoch: int, schema: str, newest: bool = False) -> DataFrame:
    """What epochs before ``epoch`` wrote (all of them, or the newest one)."""
    past = [e for e in _epochs(spark, out) if e < epoch]
    if not past:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{out}/_epoch={e}" for e in (past[-1:] if newest else past)])


def event_posts_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """posts_event as a stream: the events file read as a file stream and
    joined to the static (fixed 25-row, broadcast) nation dimension."""
    r = (spark.readStream.schema(EVENTS_SCHEMA)
              .option("pathGlobFilter", "events.parquet"))
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    ev = r.parquet(sf_dir)
    return events_to_posts(ev, _nations(spark, sf_dir))


def run_append(df: DataFrame, name: str, out: str | None = None, checkpoint: str | None = None) -> str:
    """Append every batch to Parquet, one folder per epoch; returns the folder."""
    out, checkpoint = _paths(df.sparkSession, name, out, checkpoint)
    _run(df, name, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/_epoch={epoch}"), checkpoint)
    return out


def run_counts(df: DataFrame, name: str, key: str, out: str | None = None, checkpoint: str | None = None) -> str:
    """Per epoch the counts by ``key`` of its batch (``df``: key and 0/1 or
    count columns); ``total_counts`` adds the epochs up, so a late row counts in
    its own hour whenever it comes."""
    out, checkpoint = _paths(df.sparkSession, name, out, checkpoint)

    def sink(batch: DataFrame, epoch: int):
        _summed(batch, key).write.mode("overwrite").parquet(f"{out}/_epoch={epoch}")
        if epoch % COMPACT == COMPACT - 1:
            whole = _summed(_counts_until(df.sparkSession, out, epoch), key)
            whole.write.mode("overwrite").parquet(f"{out}/folded/_epoch={epoch}")

    _run(df, name, sink, checkpoint)
    return out


def _summed(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(*[F.sum(c).cast("long").alias(c) for c in df.columns if c != key])


def _counts_until(spark: SparkSession, out: str, epoch: int | None = None) -> DataFrame:
    """The counts of all epochs up to ``epoch``: the newest folded table before
    it and the epochs after that, fewer than 2 * COMPACT folders."""
    past = [e for e in _epochs(spark, out) if epoch is None or e <= epoch]
    whole = [e for e in _epochs(spark, f"{out}/folded") if epoch is None or e < epoch][-1:]
    paths = [f"{out}/folded/_epoch={e}" for e in whole] + [f"{out}/_epoch={e}" for e in past if not whole or e > whole[0]]
    return spark.read.parquet(*paths)


def total_counts(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The counts of all epochs by ``key``."""
    return _summed(_counts_until(spark, out), key)


def run_dedup(posts: DataFrame, out: str | None = None, checkpoint: str | None = None, as_of=None) -> str:
    """ST1: of every key the first post, however late or often it comes; each
    epoch writes its new posts.  The keys so far are a keyed table beside the
    posts (``out`` + ``-keys``): a batch reads the keys of the buckets in which
    a filter finds a likely match, and no earlier epoch's posts."""
    from ..sources.ingest import KEY, first_rows
    from ..sources.keyed import KeyedTable
    spark = posts.sparkSession
    out, checkpoint = _paths(spark, "dedup", out, checkpoint)
    keys = KeyedTable(spark, f"{out}-keys")

    def sink(batch: DataFrame, epoch: int):
        last = keys.mark()
        if last is not None and epoch <= last:
            return      # written before: the batch is tried again after its keys were stored
        path = f"{out}/_epoch={epoch}"
        keys.unknown(first_rows(None, batch, as_of)).select(*batch.columns).write.mode("overwrite").parquet(path)
        keys.append(spark.read.parquet(path).select(*KEY), epoch)

    _run(posts, "dedup", sink, checkpoint)
    return out


def _one(condition):
    return F.when(condition, 1).otherwise(0)


def stream_trend(posts: DataFrame, start) -> DataFrame:
    """ST3: what ``run_counts`` sums by ``hour``: sentiment by publish time."""
    p = posts.filter((F.col("publish_time") >= ts_lit(start)) & F.col("sentiment").isNotNull())
    return p.select(F.date_format("publish_time", "yyyy-MM-dd HH:00:00").alias("hour"), F.lit(1).alias("total"),
                    _one(F.col("sentiment") == 1).alias("positive"), _one(F.col("sentiment") == 0).alias("negative"))


def stream_surge(posts: DataFrame) -> DataFrame:
    """ST4: what ``run_counts`` sums by ``minute`` of crawl time; ``surge_windows``
    makes the sliding windows of it."""
    p = posts.filter(F.col("sentiment").isNotNull())
    return p.select(F.date_trunc("minute", "crawl_time").cast("timestamp_ntz").alias("minute"),
                    F.lit(1).alias("total"), _one(F.col("sentiment") == 0).alias("negative"))


def surge_windows(per_minute: DataFrame, window_minutes: int = 60) -> DataFrame:
    """Counts of the ``window_minutes`` minutes that end with each minute."""
    from ..operators.rolling import rolling_sums
    return rolling_sums(per_minute, window_minutes)


def live_feed(posts: DataFrame, buffer: int = 200, platform: str | None = None, sentiment: int | None = None,
              out: str | None = None, checkpoint: str | None = None) -> str:
    """ST6 with F7: a rolling buffer of the newest ``buffer`` posts of a platform
    and sentiment (None: any).  An epoch writes the top of its batch and of
    the newest earlier version."""
    from ..operators.listing import feed_filter
    spark = posts.sparkSession
    out, checkpoint = _paths(spark, "live_feed", out, checkpoint)
    cols = ["id", "publish_time", "sentiment"]
    schema = "id long, publish_time timestamp_ntz, sentiment int"

    def sink(batch: DataFrame, epoch: int):
        new = feed_filter(batch, platform, sentiment).select(*cols)
        cur = new.unionByName(_before(spark, out, epoch, schema, newest=True))
        top = cur.orderBy(F.col("publish_time").desc(), F.col("id").desc()).limit(buffer)
        top.write.mode("overwrite").parquet(f"{out}/_epoch={epoch}")

    _run(posts, "live_feed", sink, checkpoint)
    last = _epochs(spark, out)
    return f"{out}/_epoch={last[-1]}" if last else out


def _recent(posts: DataFrame, lookback_minutes: int, now) -> DataFrame:
    clock = ts_lit(now) if now is not None else F.localtimestamp()
    return posts.filter(F.col("crawl_time") >= clock - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lookback_minutes)))


def _keyword_alert(word: str, preview) -> list:
    from ..operators.alerts import KEYWORD_TITLE
    return ["id", F.col(word).alias("matched_word"), F.lit("warning").alias("severity"),
            F.concat(F.lit(KEYWORD_TITLE), F.col(word)).alias("title"), preview.alias("content_preview")]


def stream_keyword_alerts(posts: DataFrame, words: list[str], lookback_minutes: int, now=None) -> DataFrame:
    """ST7: posts crawled in the last ``lookback_minutes`` before ``now`` (None:
    the time of the batch) are checked against the sensitive words (first word
    in list order); a post alerts at most once."""
    from ..operators.alerts import first_match
    m = _recent(posts, lookback_minutes, now).select("id", "content", first_match(F.col("content"), words).alias("_word"))
    return m.filter(F.col("_word").isNotNull()).select(*_keyword_alert("_word", F.substring("content", 1, 80)))


def run_keyword_alerts(posts: DataFrame, words: DataFrame, lookback_minutes: int, now=None, out: str | None = None,
                       checkpoint: str | None = None) -> str:
    """ST7 for a word table (pos, word) of any size: every batch goes through the
    automaton of the words, which are read anew for each batch, so a changed
    list counts from the next batch on.  A batch without recent posts builds no
    automaton."""
    from ..operators.words import first_words
    out, checkpoint = _paths(posts.sparkSession, "keyword_table", out, checkpoint)

    def sink(batch: DataFrame, epoch: int):
        recent = _recent(batch, lookback_minutes, now).select("id", F.substring("content", 1, 80).alias("_preview"), "content")
        asked = words.limit(0) if recent.isEmpty() else words
        (first_words(recent, asked, "id", "content").select(*_keyword_alert("word", F.col("_preview")))
         .write.mode("overwrite").parquet(f"{out}/_epoch={epoch}"))

    _run(posts, "keyword_table", sink, checkpoint)
    return out


def run_scoring(posts: DataFrame, score, top_n: int = 5, out: str | None = None, checkpoint: str | None = None,
                min_batch: int = 1, limit: int | None = None, every: str | None = None):
    """ST2: posts through the analysis job as they come: ``score`` (see
    ``operators.score``) and the top keywords; returns the folder (with
    ``every``: the folder and the running query).

    As the polling loop did: while fewer than ``min_batch`` posts wait, nothing
    is scored, and at most ``limit`` are scored at a time, the oldest ids first.
    Those that wait are kept in ``out`` + ``-waiting``, one folder an epoch, and
    join the next batch; a restart goes on with them."""
    from ..operators.score import analyse
    spark = posts.sparkSession
    out, checkpoint = _paths(spark, "score", out, checkpoint)
    schema = "id long, content string"

    def sink(batch: DataFrame, epoch: int):
        waiting = _before(spark, f"{out}-waiting", epoch, schema, newest=True)
        own = batch.select(F.col("id").cast("long").alias("id"), "content").unionByName(waiting)
        few = min_batch > 1 and own.limit(min_batch).count() < min_batch
        now = own.limit(0) if few else own if limit is None else own.orderBy("id").limit(limit)
        if few or limit is not None:
            now = now.persist()
            rest = own if few else own.join(now.select("id"), "id", "left_anti")
            rest.write.mode("overwrite").parquet(f"{out}-waiting/_epoch={epoch}")
        elif min_batch > 1:
            own.limit(0).write.mode("overwrite").parquet(f"{out}-waiting/_epoch={epoch}")
        analyse(now, score, top_n).write.mode("overwrite").parquet(f"{out}/_epoch={epoch}")
        now.unpersist()

    q = _run(posts, "score", sink, checkpoint, every=every)
    return out if every is None else (out, q)


class HeartbeatListener:
    """ST8: turns streaming query progress into heartbeat rows
    (module_name, status, ts, metadata) on the driver; progress events are
    small metadata, one per micro-batch."""

    def __init__(self):
        from pyspark.sql.streaming import StreamingQueryListener

        beats = self.beats = []

        class _L(StreamingQueryListener):
            def onQueryStarted(self, event):
                pass

            def onQueryProgress(self, event):
                p = event.progress
                beats.append((p.name or str(p.id), "healthy", p.timestamp,
                              '{"batch":%d,"rows":%d}' % (p.batchId, p.numInputRows)))

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                if event.exception:
                    beats.append((str(event.id), "degraded", None, '{"error":true}'))

        self.listener = _L()

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(m, s, t, md) for m, s, t, md in self.beats]
        df = spark.createDataFrame(rows, "module_name string, status string, ts_text string, metadata string")
        return df.withColumn("ts", F.to_timestamp("ts_text").cast("timestamp_ntz")).drop("ts_text")


def _fire(hours: dict):
    """The state function of ``run_silenced_alerts``: the alerts of one key that
    fire, in time order, on top of the key's last fired time."""
    import numpy as np
    import pandas as pd

    def fire(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:       # silent for longer than its silence: any later alert fires anyway
            state.remove()
            return
        silence = hours.get(key[0], 0) * 3_600_000_000
        rows = [(p["t"].to_numpy(), p["id"].to_numpy()) for p in parts]
        t, i = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        order = np.lexsort((i, t))
        t, i = t[order], i[order]
        last = state.get[0] if state.exists else None
        at = 0 if last is None else int(np.searchsorted(t, last + silence, "right"))
        fired = []
        while at < len(t):          # one look-up a fired alert; of one time the smallest id
            fired.append(at)
            last = int(t[at])
            at = int(np.searchsorted(t, last + silence, "right"))
        if last is not None:
            state.update((last,))
            quiet = (last + silence) // 1000 + 1
            state.setTimeoutTimestamp(max(quiet, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": i[fired], "alert_type": key[0], "related_topic_id": pd.array([key[1]] * len(fired), dtype="Int64"),
                            "t": t[fired]})

    return fire


def run_silenced_alerts(candidates: DataFrame, silence_hours: dict, out: str | None = None,
                        checkpoint: str | None = None, late: str = "1 hour") -> tuple[str, int]:
    """ST5: the alerts that fire, with the silence of (alert_type,
    related_topic_id) kept as Spark's keyed state: the last fired time of every
    key, with a timer that ends it when the silence is over.  An epoch touches
    only the keys of its batch.  Returns the folder of fired alerts (id,
    alert_type, related_topic_id, created_at) and the number of keys in state.

    Candidates (id, alert_type, related_topic_id, created_at) are taken batch by
    batch, in a batch by time; the answer is that of one ``alerts.replay``
    over all, however they are cut into files, as long as files come in time
    order.  An alert older than its key's last firing, or than the watermark
    (``late`` behind the newest alert of earlier batches), came too late to
    fire.  A batch's alerts of one key meet in one task; ``maxFilesPerTrigger``
    of the source bounds them."""
    spark = candidates.sparkSession
    out, checkpoint = _paths(spark, "silenced_alerts", out, checkpoint)
    t = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("created_at"))
    rows = (candidates.select("id", "alert_type", "related_topic_id", t.alias("t"))
                      .withColumn("event_time", F.timestamp_micros("t")).withWatermark("event_time", late))
    fired = (rows.groupBy("alert_type", "related_topic_id")
                 .applyInPandasWithState(_fire(dict(silence_hours)), "id long, alert_type string, related_topic_id long, t long",
                                         "last long", "append", "EventTimeTimeout"))

    def sink(batch: DataFrame, epoch: int):
        (batch.withColumn("created_at", F.expr("timestampadd(MICROSECOND, t, TIMESTAMP_NTZ'1970-01-01 00:00:00')")).drop("t")
              .write.mode("overwrite").parquet(f"{out}/alerts/_epoch={epoch}"))

    q = _run(fired, "silenced_alerts", sink, checkpoint)
    state = (q.lastProgress or {}).get("stateOperators") or [{}]
    return f"{out}/alerts", int(state[0].get("numRowsTotal", 0))
