"""Alert rules, silence, replay and keyword routing.

Rules are configuration rows; posts are the data.  Every rule is one
aggregate or one projection over the posts; no per-post or per-topic query
loop, no all-pairs join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.timefmt import hours_before, minutes_before, percent_1dp, round_half_up, ts_lit
from ..session import cut
from .rolling import rolling_sums
from .words import first_words, word_matches

# Alert titles and message formats of the studied system.
SURGE_TITLE = "负面舆情突增预警"
SURGE_DESC = "近%d小时负面占比 %.1f%% (%d/%d条), 超过阈值 %.0f%%"
KEYWORD_TITLE = "敏感词触发: "
KEYWORD_DESC_HEAD = "帖子内容包含敏感词「"
KEYWORD_DESC_TAIL = "」: "
GROWTH_TITLE = "话题异常增长: "
GROWTH_DESC = "话题「%s」在%d小时内帖子数增长 %.0f%% (%d→%d), 超过阈值 %.0f%%"

ALERT_COLUMNS = ["alert_type", "severity", "title", "description", "related_topic_id",
                 "trigger_data", "created_at", "source_id"]


# ---------------------------------------------------------------- matching

FEW_WORDS = 64    # a list up to this long is tested word by word

def _words(words) -> Column:
    """The words as an array literal, blank ones left out."""
    return F.array(*[F.lit(w) for w in words if w and w.strip()]).cast("array<string>")


def all_matches(content: Column, words) -> Column:
    """The words (list order) that ``content`` contains, case-sensitive."""
    return F.filter(_words(words), lambda w: F.contains(content, w))


def first_match(content: Column, words) -> Column:
    """The first word of ``words`` (list order) that ``content`` contains,
    case-sensitive; NULL when none does.  Blank words never match."""
    return F.get(all_matches(content, words), F.lit(0))


def keyword_hits(posts: DataFrame, words: list[str] | DataFrame) -> DataFrame:
    """Posts containing a sensitive word, with the first word matched.  A
    list is tested word by word; a table (pos, word) of any size goes through
    an automaton, whose cost does not depend on the number of words."""
    if isinstance(words, DataFrame):
        return first_words(posts.select("id", "content"), words, "id", "content").select("id", F.col("word").alias("matched_word"))
    return (posts.select("id", first_match(F.col("content"), words).alias("matched_word"))
                 .filter(F.col("matched_word").isNotNull()))


def held_words(texts: DataFrame, words: DataFrame, text_col: str) -> DataFrame:
    """The other columns of ``texts`` and _w: one row per text and word of the
    table ``words`` (_w) that it holds.  Up to FEW_WORDS are tested in the
    projection, more by an automaton."""
    few = sorted(r[0] for r in words.select("_w").distinct().limit(FEW_WORDS + 1).collect())
    keep = [c for c in texts.columns if c != text_col]
    if len(few) <= FEW_WORDS:
        return texts.select(*keep, F.explode(all_matches(F.col(text_col), few)).alias("_w"))
    listed = words.select(F.lit(0).cast("long").alias("pos"), F.col("_w").alias("word"))
    return word_matches(texts, listed, text_col).select(*keep, F.col("word").alias("_w"))


def monitored_posts(posts: DataFrame, keywords: DataFrame) -> DataFrame:
    """Hits per monitored keyword and post platform.

    A keyword applies to a post when its platform is ``all`` or the post's
    platform and the content contains it (ignoring case); blank keywords apply
    to none.  One pass over the posts names the words that each contains, and
    the matches are joined with the keyword table by the word.
    """
    kw = (keywords.filter(F.col("enabled") & (F.trim("keyword") != ""))
                  .select("keyword", F.lower("keyword").alias("_kw"), F.col("platform").alias("_kp")))
    found = held_words(posts.select("platform", F.lower("content").alias("_text")), kw.select(F.col("_kw").alias("_w")), "_text")
    found = found.withColumnRenamed("_w", "_kw")
    counts = found.groupBy("platform", "_kw").agg(F.count(F.lit(1)).alias("n"))
    hits = counts.join(kw, "_kw").filter((F.col("_kp") == "all") | (F.col("_kp") == F.col("platform")))
    return hits.groupBy("keyword", "platform").agg(F.sum("n").alias("hits"))


# ----------------------------------------------------------------- rules

def parse_rules(rules: DataFrame) -> DataFrame:
    """(rule_id, rule_type, silence_hours and one struct per rule type) of
    the enabled rules, their JSON config parsed by a declared schema per type."""
    out = rules.filter(F.col("enabled")).withColumnRenamed("id", "rule_id")
    for rtype, sch in S.RULE_CONFIGS.items():
        out = out.withColumn(rtype, F.when(F.col("rule_type") == rtype, F.from_json("config", sch)))
    hours = F.coalesce(*[F.col(f"{t}.silenceHours") for t in S.RULE_CONFIGS], F.lit(0))
    return out.select("rule_id", "rule_type", hours.cast("int").alias("silence_hours"), *S.RULE_CONFIGS)


def _hours_back(column: str, as_of) -> Column:
    """The smallest whole number of hours h >= 0 with time >= as_of - h hours."""
    us = F.timestamp_diff("MICROSECOND", F.col(column), ts_lit(as_of))
    return F.greatest(F.lit(0), F.ceil(us / F.lit(3_600_000_000))).cast("int")


def _per_hour_of(rules: DataFrame, window: str) -> DataFrame:
    """Every rule once for each hour back that its window holds."""
    return rules.withColumn("_h", F.explode(F.sequence(F.lit(0), F.col(window))))


def _widest(rules: DataFrame, window: str) -> int:
    return int(rules.agg(F.max(window)).first()[0] or 0)


def surge_candidates(posts: DataFrame, rules: DataFrame, as_of) -> DataFrame:
    """L1 for every rule (rule_id, silence_hours, threshold, min_posts,
    window_hours): one alert row when, among posts crawled in the window,
    analysed posts >= ``min_posts`` and the negative share >= ``threshold``.
    Where rules have ``baseline_hours`` and ``baseline_threshold`` (null: no
    condition), the share must also exceed that of the ``baseline_hours`` before
    the window by the threshold; without analysed posts there, nothing is exceeded.
    One pass over the posts, counted by hour back, serves all rules."""
    baseline = "baseline_hours" in rules.columns
    if not baseline:
        rules = rules.withColumn("baseline_hours", F.lit(None).cast("int")).withColumn("baseline_threshold", F.lit(None).cast("double"))
    rules = rules.withColumn("_reach", F.col("window_hours") + F.coalesce("baseline_hours", F.lit(0)))
    recent = posts.filter(F.col("crawl_time") >= hours_before(as_of, _widest(rules, "_reach")))
    per = (recent.groupBy(_hours_back("crawl_time", as_of).alias("_h"))
                 .agg(F.count_if(F.col("sentiment").isNotNull()).alias("n"), F.count_if(F.col("sentiment") == 0).alias("neg")))
    names = ["rule_id", "silence_hours", "threshold", "min_posts", "window_hours", "baseline_threshold"]
    own = F.col("_h") <= F.col("window_hours")
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long")
    agg = (per.join(_per_hour_of(rules, "_reach"), "_h").groupBy(*names)
              .agg(total("n", own).alias("total_posts"), total("neg", own).alias("negative_posts"),
                   total("n", ~own).alias("_bn"), total("neg", ~own).alias("_bneg")))
    ratio = F.col("negative_posts") / F.col("total_posts")
    rises = F.col("baseline_threshold").isNull() | ((F.col("_bn") > 0) & (ratio - F.col("_bneg") / F.nullif("_bn", F.lit(0)) >= F.col("baseline_threshold")))
    fired = agg.filter((F.col("total_posts") > 0) & (F.col("total_posts") >= F.col("min_posts"))
                       & (ratio >= F.col("threshold"))).filter(rises)
    pct = percent_1dp(ratio)
    return fired.select(
        F.lit("negative_surge").alias("alert_type"),
        F.when(ratio >= 0.8, "critical").otherwise("warning").alias("severity"),
        "total_posts", "negative_posts", pct.alias("negative_ratio"),
        F.lit(SURGE_TITLE).alias("title"),
        F.format_string(SURGE_DESC, "window_hours", ratio * 100, F.col("negative_posts"),
                        F.col("total_posts"), F.col("threshold") * 100).alias("description"),
        F.lit(None).cast("long").alias("related_topic_id"),
        F.lit(None).cast("long").alias("source_id"),
        F.to_json(F.struct(F.col("total_posts").alias("totalPosts"),
                           F.col("negative_posts").alias("negativePosts"),
                           pct.alias("negativeRatio"),
                           (F.col("threshold") * 100).alias("threshold"),
                           F.col("window_hours").alias("windowHours"))).alias("trigger_data"),
        ts_lit(as_of).alias("created_at"), "rule_id", "silence_hours")


def negative_surge(posts: DataFrame, as_of, threshold: float = 0.6, min_posts: int = 20, window_hours: int = 1,
                   baseline_hours: int | None = None, baseline_threshold: float | None = None) -> DataFrame:
    """L1 for one rule given by its values; the baseline condition is off unless given."""
    rule = posts.sparkSession.createDataFrame(
        [(0, 0, float(threshold), min_posts, window_hours, baseline_hours, baseline_threshold)],
        "rule_id long, silence_hours int, threshold double, min_posts long, window_hours int, baseline_hours int, baseline_threshold double")
    return surge_candidates(posts, rule, as_of).drop("rule_id", "silence_hours")


def keyword_alerts(posts: DataFrame, words: list[str], as_of, lookback_minutes: int = 5) -> DataFrame:
    """L2 for one word list: one warning per post crawled in the lookback that
    contains a sensitive word (first word in list order)."""
    rows = [(0, 0, list(words))]
    rule = posts.sparkSession.createDataFrame(rows, "rule_id long, silence_hours int, words array<string>")
    return keyword_candidates(posts, rule, as_of, lookback_minutes).drop("rule_id", "silence_hours")


def keyword_candidates(posts: DataFrame, rules: DataFrame, as_of, lookback_minutes: int = 5) -> DataFrame:
    """L2 for every rule (rule_id, silence_hours, words).  One pass over the
    recent posts names the words that each contains; the first in a rule's
    list is found after a join of the matches with the rules' words.  Matches
    carry the preview of their post, never its whole text."""
    listed = (rules.select("rule_id", "silence_hours", F.posexplode("words").alias("_i", "_w"))
                   .filter(F.trim("_w") != ""))
    recent = (posts.filter(F.col("crawl_time") >= minutes_before(as_of, lookback_minutes))
                   .select("id", "platform", F.substring("content", 1, 100).alias("_preview"), "content"))
    found = held_words(recent, listed.select("_w"), "content")
    m = (found.join(listed, "_w").groupBy("id", "rule_id", "silence_hours")
              .agg(F.min_by(F.struct(F.col("_w").alias("matched_word"), "platform", "_preview"), "_i").alias("_m"))
              .select("id", "rule_id", "silence_hours", "_m.*"))
    prev80 = F.substring("_preview", 1, 80)
    return m.select(
        "id", "matched_word",
        F.lit("keyword_trigger").alias("alert_type"),
        F.lit("warning").alias("severity"),
        F.concat(F.lit(KEYWORD_TITLE), F.col("matched_word")).alias("title"),
        prev80.alias("content_preview"),
        F.concat(F.lit(KEYWORD_DESC_HEAD), F.col("matched_word"), F.lit(KEYWORD_DESC_TAIL),
                 F.col("_preview")).alias("description"),
        F.lit(None).cast("long").alias("related_topic_id"),
        F.col("id").alias("source_id"),
        F.to_json(F.struct(F.col("id").alias("postId"), F.col("platform"),
                           F.col("matched_word").alias("matchedWord"),
                           prev80.alias("contentPreview"))).alias("trigger_data"),
        ts_lit(as_of).alias("created_at"), "rule_id", "silence_hours")


def growth_candidates(topics: DataFrame, posts: DataFrame, rules: DataFrame, as_of, min_previous: int = 5) -> DataFrame:
    """L3 for every rule (rule_id, silence_hours, rate > -1, window_hours):
    topics whose posts since the cutoff / posts before it >= 1 + rate; critical
    from 1 + 2 * rate.  Posts are counted once by topic and hour back."""
    per = (posts.filter(F.col("topic_id").isNotNull())
                .groupBy("topic_id", F.least(_hours_back("crawl_time", as_of),
                                             F.lit(_widest(rules, "window_hours") + 1)).alias("_h"))
                .agg(F.count(F.lit(1)).alias("n")))
    total = per.groupBy("topic_id").agg(F.sum("n").alias("_all"))
    now = (per.join(_per_hour_of(rules, "window_hours"), "_h")
              .groupBy("topic_id", "rule_id", "silence_hours", "rate", "window_hours")
              .agg(F.sum("n").cast("long").alias("current_count")))
    g = now.join(total, "topic_id").withColumn("previous_count", (F.col("_all") - F.col("current_count")).cast("long"))
    t = (topics.filter((F.col("status") == "active") & F.col("first_seen").isNotNull())
               .select(F.col("id").alias("topic_id"), "topic_name", _hours_back("last_updated", as_of).alias("_updated")))
    g = (g.join(t, "topic_id").filter(F.col("_updated") <= F.col("window_hours"))
          .filter(F.col("previous_count") >= F.greatest(F.lit(min_previous), F.lit(1)))
          .withColumn("growth", F.col("current_count") / F.col("previous_count"))
          .filter(F.col("growth") >= 1 + F.col("rate")))
    growth_r = round_half_up(F.col("growth"), 2)
    return g.select(
        "topic_id",
        F.lit("topic_growth").alias("alert_type"),
        F.when(F.col("growth") >= 1 + 2 * F.col("rate"), "critical").otherwise("warning").alias("severity"),
        "current_count", "previous_count",
        growth_r.alias("growth_rate"),
        F.concat(F.lit(GROWTH_TITLE), F.col("topic_name")).alias("title"),
        F.format_string(GROWTH_DESC, F.col("topic_name"), F.col("window_hours"),
                        (F.col("growth") - 1) * 100, F.col("previous_count"),
                        F.col("current_count"), F.col("rate") * 100).alias("description"),
        F.col("topic_id").alias("related_topic_id"),
        F.col("topic_id").alias("source_id"),
        F.to_json(F.struct(F.col("topic_id").alias("topicId"), F.col("topic_name").alias("topicName"),
                           F.col("current_count").alias("currentCount"),
                           F.col("previous_count").alias("previousCount"),
                           growth_r.alias("growthRate"))).alias("trigger_data"),
        ts_lit(as_of).alias("created_at"), "rule_id", "silence_hours")


def topic_growth_alerts(topics: DataFrame, posts: DataFrame, as_of, rate: float = 3.0,
                        window_hours: int = 24, min_previous: int = 5) -> DataFrame:
    """L3 for one rule given by its values."""
    rule = posts.sparkSession.createDataFrame([(0, 0, float(rate), window_hours)],
                                              "rule_id long, silence_hours int, rate double, window_hours int")
    return growth_candidates(topics, posts, rule, as_of, min_previous).drop("rule_id", "silence_hours")


# ---------------------------------------------------------------- silence

def _hours_by_type(silence_hours: dict) -> Column:
    hours = F.lit(None).cast("int")
    for k, v in silence_hours.items():
        hours = F.when(F.col("alert_type") == k, F.lit(v)).otherwise(hours)
    return hours


def silence(candidates: DataFrame, prior: DataFrame, silence_hours=None, null_safe: bool = True) -> DataFrame:
    """Mark candidates that an alert of the same type and topic
    silences (created at or after ``candidate time - silence_hours``).

    ``silence_hours`` is a number, a ``{alert_type: hours}`` mapping, or None:
    then every candidate carries its own in a column of that name.  The
    prior alerts are reduced to their latest time per (type, topic) before the
    join, so a hot key costs one row, never a pair per earlier alert.
    ``null_safe=False`` reproduces the original ``=`` that never matches a
    NULL topic.
    """
    hours = (F.col("silence_hours") if silence_hours is None else
             _hours_by_type(silence_hours) if isinstance(silence_hours, dict) else F.lit(silence_hours))
    last = (prior.groupBy(F.col("alert_type").alias("_pt"), F.col("related_topic_id").alias("_ptopic"))
                 .agg(F.max("created_at").alias("_last")))
    topic_eq = (F.col("related_topic_id").eqNullSafe(F.col("_ptopic")) if null_safe
                else F.col("related_topic_id") == F.col("_ptopic"))
    j = candidates.join(last, (F.col("alert_type") == F.col("_pt")) & topic_eq, "left")
    cutoff = F.col("created_at") - F.make_dt_interval(F.lit(0), hours.cast("int"))
    # As the original: any alert of the key created since (time - silence)
    # counts, with no upper bound.
    suppressed = F.coalesce(F.col("_last") >= cutoff, F.lit(False))
    return j.withColumn("suppressed", suppressed).drop("_pt", "_ptopic", "_last")


_NO_TOPIC = -(1 << 62)


def _micros(column: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))


def replay(history: DataFrame, silence_hours: dict, seed: DataFrame | None = None) -> DataFrame:
    """L5 over a history: ``history`` (id, alert_type, related_topic_id,
    created_at, ..) with ``suppressed``.  Alerts are taken in time order; one
    fires unless an alert of its type and topic fired within its type's silence
    before it (bounds included), and of one time only the smallest id fires.
    ``seed`` (alert_type, related_topic_id, last) holds earlier firings.

    The fired times of a key are a chain: the first time, then the first time
    later than the silence after it, and so on.  Every distinct time gets a
    pointer to its successor -- found inside a block of the time axis, or as
    the start of the next block that has a time -- and the chain is marked by
    pointer doubling, so no key is walked in one task and the rounds grow with
    the logarithm of the chain."""
    key = ["alert_type", "_k"]
    hours = _hours_by_type(silence_hours)
    h = history.withColumn("_k", F.coalesce("related_topic_id", F.lit(_NO_TOPIC))).withColumn("_t", _micros("created_at"))
    # of one time, the smallest id stands for all
    times = h.groupBy(*key, "_t").agg(F.min("id").alias("_first"))
    times = times.withColumn("_s", F.coalesce(hours, F.lit(0)).cast("long") * 3_600_000_000)
    if seed is not None:
        s = seed.select("alert_type", F.coalesce("related_topic_id", F.lit(_NO_TOPIC)).alias("_k"), _micros("last").alias("_last"))
        times = times.join(s, key, "left").filter(F.col("_last").isNull() | (F.col("_t") > F.col("_last") + F.col("_s")))
    times = cut(times.select(*key, "_t", "_s", "_first"))
    width = F.greatest(F.col("_s"), F.lit(3_600_000_000))
    rows = (times.select(*key, "_s", F.col("_t").alias("at"), F.lit(1).alias("is_time"), F.lit(None).cast("long").alias("of"))
                 .unionByName(times.select(*key, "_s", (F.col("_t") + F.col("_s")).alias("at"), F.lit(0).alias("is_time"),
                                           F.col("_t").alias("of")))
                 .withColumn("block", F.floor(F.col("at") / width)))
    inside = Window.partitionBy(*key, "block").orderBy(F.col("at").desc(), "is_time").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("here", F.min(F.when(F.col("is_time") == 1, F.col("at"))).over(inside))
    later = Window.partitionBy(*key).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy(*key, "block").agg(F.min(F.when(F.col("is_time") == 1, F.col("at"))).alias("_b"))
                  .withColumn("there", F.min("_b").over(later)).drop("_b"))
    step = cut(rows.filter("is_time = 0").join(starts, [*key, "block"])
                   .select(*key, F.col("of").alias("_t"), F.coalesce("here", "there").alias("_n")))
    fired = cut(times.groupBy(*key).agg(F.min("_t").alias("_t")))
    while not step.filter("_n IS NOT NULL").isEmpty():
        fired = cut(fired.unionByName(fired.join(step, [*key, "_t"]).filter("_n IS NOT NULL")
                                           .select(*key, F.col("_n").alias("_t"))).distinct())
        onward = step.select(*key, F.col("_t").alias("_n"), F.col("_n").alias("_n2"))
        step = cut(step.filter("_n IS NOT NULL").join(onward, [*key, "_n"]).select(*key, "_t", F.col("_n2").alias("_n")))
    won = fired.join(times, [*key, "_t"]).select("alert_type", "_k", "_t", "_first", F.lit(True).alias("_won"))
    return (h.join(won, [*key, "_t"], "left")
             .withColumn("suppressed", ~(F.coalesce("_won", F.lit(False)) & (F.col("id") == F.coalesce("_first", "id"))))
             .drop("_k", "_t", "_first", "_won"))


# -------------------------------------------------------------- backtest

def negative_surge_backtest(posts: DataFrame, window_minutes: int = 60, threshold: float = 0.6,
                            min_posts: int = 20) -> DataFrame:
    """The surge rule replayed at every minute.

    Posts are pre-aggregated to one row per crawl minute; the windows are
    running totals of two signed rows a minute (``rolling_sums``), so the work
    does not depend on the window's length.  One row per minute whose trailing
    window holds an analysed post.
    """
    minute = F.date_trunc("minute", F.col("crawl_time")).cast("timestamp_ntz")
    per_min = (posts.filter(F.col("sentiment").isNotNull())
                    .groupBy(minute.alias("minute"))
                    .agg(F.count(F.lit(1)).alias("total"),
                         F.count_if(F.col("sentiment") == 0).cast("long").alias("negative")))
    out = rolling_sums(per_min, window_minutes)
    ratio = F.col("negative") / F.col("total")
    return out.select("minute", "total", "negative", F.round(ratio, 6).alias("ratio"),
                      ((F.col("total") >= min_posts) & (ratio >= threshold)).alias("fires"))


# -------------------------------------------------------------- dispatch

def evaluate_rules(posts: DataFrame, topics: DataFrame, rules: DataFrame, prior: DataFrame | None,
                   as_of, keyword_lookback_minutes: int = 5, null_safe: bool = True, baseline: bool = False) -> DataFrame:
    """L4: every enabled rule, one pass over the posts per rule type, silenced
    by the rule's own hours against ``prior`` alerts and by earlier alerts of the
    same run: all candidates carry the run time, so of the candidates of one
    (type, topic) key that no prior alert silences, only the first by rule and
    source (post id, topic id) fires -- found with a per-key ``min``.
    ``null_safe=False`` reproduces the original, where a NULL topic never
    silences anything; ``baseline=True`` applies the baseline that surge rules
    configure, which the original reads and never uses."""
    r = cut(parse_rules(rules))

    def of(kind, **fields):
        return (r.filter(F.col("rule_type") == kind)
                 .select("rule_id", "silence_hours", *[F.col(f"{kind}.{f}").cast(t).alias(n) for n, (f, t) in fields.items()]))

    extra = {"baseline_hours": ("baselineHours", "int"), "baseline_threshold": ("baselineThreshold", "double")} if baseline else {}
    frames = [
        surge_candidates(posts, of("negative_surge", threshold=("negativeRatioThreshold", "double"),
                                   min_posts=("minPostCount", "long"), window_hours=("windowHours", "int"), **extra), as_of),
        keyword_candidates(posts, of("keyword_trigger", words=("sensitiveWords", "array<string>")), as_of,
                           keyword_lookback_minutes),
        growth_candidates(topics, posts, of("topic_growth", rate=("growthRateThreshold", "double"),
                                            window_hours=("windowHours", "int")), as_of)]
    out = None
    for f in frames:
        f = f.select(*ALERT_COLUMNS, "rule_id", "silence_hours")
        out = f if out is None else out.unionByName(f)
    if prior is not None:
        out = silence(out, prior.select("alert_type", "related_topic_id", "created_at"), None, null_safe)
    else:
        out = out.withColumn("suppressed", F.lit(False))
    out = cut(out)
    order = F.struct("rule_id", F.coalesce("source_id", F.lit(_NO_TOPIC)).alias("source"))
    first = (out.filter(~F.col("suppressed"))
                .groupBy(F.col("alert_type").alias("_ft"), F.col("related_topic_id").alias("_fk"))
                .agg(F.min(order).alias("_first")))
    j = out.join(first, (F.col("alert_type") == F.col("_ft"))
                 & F.col("related_topic_id").eqNullSafe(F.col("_fk")), "left")
    later = F.coalesce(order > F.col("_first"), F.lit(False))
    if not null_safe:
        later = later & F.col("related_topic_id").isNotNull()
    return j.withColumn("suppressed", F.col("suppressed") | later).drop("_ft", "_fk", "_first")


def upsert_config(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Apply maintenance rows (``op`` in insert/update/delete) to a config
    table: inserts add unseen keys, updates overwrite only the fields they
    carry (NULL keeps the old value), deletes drop the key."""
    cols = [c for c in table.columns if c not in key]
    ch = changes
    ins = ch.filter(F.col("op") == "insert").select(*table.columns).join(table.select(*key), key, "left_anti")
    upd = ch.filter(F.col("op") == "update").select(*key, *[F.col(c).alias("_n_" + c) for c in cols])
    dele = ch.filter(F.col("op") == "delete").select(*key)
    kept = table.join(dele, key, "left_anti").join(upd, key, "left")
    kept = kept.select(*key, *[F.coalesce(F.col("_n_" + c), F.col(c)).alias(c) for c in cols])
    return kept.unionByName(ins)
