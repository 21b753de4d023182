"""Dictionary segmentation of letter runs (T1): learned words and best paths.

A run is a maximal sequence of letters and digits of a lower-cased text; Han
characters form runs of their own.  ``learn_dictionary`` finds the words of a
corpus without any list: a string of 2 to ``max_len`` characters is a word if
it occurs often, if its parts occur together far more often than by chance
(pointwise mutual information of its weakest cut) and if it is free on both
sides (entropy of the characters before and after it).  ``segment_runs`` then
cuts every run along the path of least total cost, a word's cost being its
negative log probability (Viterbi).

All statistics are of distinct runs weighted by their counts, so a word in
every text is one row of work per task.  The dictionary is never shipped: the
substrings of the distinct runs meet it in a join with salted keys, and the
path of a run is found from its own matches, at most ``max_len`` a character."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import HAN_RUN, SPLIT_PATTERN, STOP_WORDS_TOPIC
from ..session import cut

MAX_LEN = 6
MIN_COUNT = 20
MIN_PMI = 1.0        # nats, at the weakest cut
MIN_ENTROPY = 1.2    # nats, on the poorer side
UNIT = 1_000_000     # costs are whole millionths of a nat, so that paths compare exactly
UNKNOWN = 30 * UNIT  # cost of a character that the dictionary lacks
SALTS = 16
TOGETHER = 256       # runs of at most so many characters are stepped through together
CELLS = 1 << 21      # characters times longest word that are stepped through together


def text_runs(text) -> F.Column:
    """The runs of a text (array, repeats kept)."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), HAN_RUN, " $1 ")
    return F.filter(F.split(F.lower(spaced), SPLIT_PATTERN), lambda r: r != "")


def post_runs(posts: DataFrame) -> DataFrame:
    """(id, run, n): the runs of every post with their counts."""
    return (posts.select("id", F.explode(text_runs(F.col("content"))).alias("run"))
            .groupBy("id", "run").agg(F.count(F.lit(1)).alias("n")))


def run_counts(posts: DataFrame) -> DataFrame:
    """(run, n) over all posts."""
    return posts.select(F.explode(text_runs(F.col("content"))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def _substrings(runs: DataFrame, max_len: int, *keep: str) -> DataFrame:
    """One row per substring of up to ``max_len`` characters of each run: the
    columns ``keep``, chars, start (from 1), len, gram."""
    chars = runs.withColumn("chars", F.split("run", ""))
    at = chars.select(*keep, "chars", F.explode(F.sequence(F.lit(1), F.size("chars"))).alias("start"))
    spans = at.select(*keep, "chars", "start",
                      F.explode(F.sequence(F.lit(1), F.least(F.lit(max_len), F.size("chars") - F.col("start") + 1))).alias("len"))
    return spans.withColumn("gram", F.array_join(F.slice("chars", F.col("start"), F.col("len")), ""))


def gram_statistics(runs: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """(gram, freq, entropy): occurrences of every substring and the entropy of
    its neighbours on the poorer side (the edge of a run is one neighbour)."""
    side = F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.when(F.col("start") > 1, F.get("chars", F.col("start") - 2)).otherwise(F.lit("")).alias("ch")),
        F.struct(F.lit(1).alias("side"), F.coalesce(F.get("chars", F.col("start") + F.col("len") - 1), F.lit("")).alias("ch")))).alias("s")
    near = (_substrings(runs, max_len, "n").select("gram", "n", side).groupBy("gram", "s.side", "s.ch")
            .agg(F.sum("n").alias("c")).groupBy("gram", "side").agg(F.sum("c").alias("freq"), F.sum(F.col("c") * F.log("c")).alias("l")))
    return (near.withColumn("h", F.log("freq") - F.col("l") / F.col("freq"))
            .groupBy("gram").agg(F.max("freq").alias("freq"), F.min("h").alias("entropy")))


def learn_dictionary(runs: DataFrame, max_len: int = MAX_LEN, min_count: int = MIN_COUNT, min_pmi: float = MIN_PMI,
                     min_entropy: float = MIN_ENTROPY) -> DataFrame:
    """(word, freq, pmi, entropy) learned from (run, n); single characters are
    words without conditions (pmi null), so that every run has a path."""
    stats = cut(gram_statistics(runs, max_len))
    single = stats.filter("length(gram) = 1")
    total = single.agg(F.sum("freq")).first()[0] or 0
    able = stats.filter((F.length("gram") > 1) & (F.col("freq") >= min_count) & (F.col("entropy") >= min_entropy))
    cuts = able.select("gram", F.col("freq").alias("both"), F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("k"))
    cuts = cuts.select("gram", "both", F.expr("substring(gram, 1, k)").alias("a"), F.expr("substring(gram, k + 1)").alias("b"))
    fa = stats.select(F.col("gram").alias("a"), F.col("freq").alias("na"))
    fb = stats.select(F.col("gram").alias("b"), F.col("freq").alias("nb"))
    pmi = (cuts.join(fa, "a").join(fb, "b")
           .groupBy("gram").agg(F.min(F.log(F.col("both") * float(total) / F.col("na") / F.col("nb"))).alias("pmi")))
    words = able.join(pmi.filter(F.col("pmi") >= min_pmi), "gram")
    cols = [F.col("gram").alias("word"), "freq"]
    return (words.select(*cols, "pmi", "entropy")
            .unionByName(single.select(*cols, F.lit(None).cast("double").alias("pmi"), "entropy")))


def word_costs(dictionary: DataFrame) -> DataFrame:
    """(word, cost): negative log probability in whole millionths of a nat;
    ``dictionary`` needs word and freq (> 0).  A word listed twice counts as one."""
    d = dictionary.filter("word <> '' AND freq > 0").groupBy(F.lower("word").alias("word")).agg(F.sum("freq").alias("freq"))
    total = d.agg(F.sum("freq")).first()[0]
    return d.select("word", F.round(-F.log(F.col("freq") / float(total or 1)) * UNIT).cast("long").alias("cost"))


def best_path(length: int, arcs) -> list[int]:
    """Ends of the words on the path of least cost over ``arcs`` (start from 1,
    len, cost); of equal costs the longest last word."""
    by_end: dict[int, list[tuple[int, int]]] = {}
    for start, size, cost in arcs:
        by_end.setdefault(start + size - 1, []).append((start - 1, cost))
    best, back = [0] * (length + 1), [0] * (length + 1)
    for end in range(1, length + 1):
        ways = by_end.get(end, [])
        if not any(start == end - 1 for start, _ in ways):
            ways = [*ways, (end - 1, UNKNOWN)]
        best[end], back[end] = min((best[start] + cost, start) for start, cost in ways)
    ends, at = [], length
    while at:
        ends.append(at)
        at = back[at]
    return ends[::-1]


def best_paths(lengths: np.ndarray, run: np.ndarray, start: np.ndarray, size: np.ndarray, cost: np.ndarray) -> list[list[int]]:
    """``best_path`` of many runs, end by end for all of them at once; the arcs
    are columns: run (number from 0), start (from 1), len, cost."""
    base = np.cumsum(lengths + 1) - lengths - 1
    inside = start + size - 1 <= lengths[run]
    run, start, size, cost = run[inside], start[inside], size[inside], cost[inside]
    back_by = np.arange(size.max(initial=1), 0, -1)     # the longest word first: it wins among equal costs
    way = np.full((int((lengths + 1).sum()), len(back_by)), 1 << 60, dtype=np.int64)
    way[:, -1] = UNKNOWN
    at = base[run] + start + size - 1
    way[at[size == 1], -1] = 1 << 60
    np.minimum.at(way, (at, len(back_by) - size), cost)
    best, back = np.zeros(len(way), dtype=np.int64), np.zeros(len(way), dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    first, long = base[order], -lengths[order]
    for end in range(1, int(lengths.max(initial=0)) + 1):
        here = first[:np.searchsorted(long, -end, "right")] + end
        total = way[here] + best[np.maximum(here[:, None] - back_by, 0)]
        which = total.argmin(axis=1)
        best[here] = total[np.arange(len(here)), which]
        back[here] = end - back_by[which]
    ends = np.zeros(len(way), dtype=bool)
    left, to = base, lengths
    while len(to):
        left, to = left[to > 0], to[to > 0]
        ends[left + to] = True
        to = back[left + to]
    where = np.flatnonzero(ends)
    owner = np.searchsorted(base, where, "right") - 1
    cuts = np.searchsorted(owner, np.arange(1, len(lengths)))
    return [x.tolist() for x in np.split(where - base[owner], cuts)] if len(lengths) else []


def segment_runs(runs: DataFrame, costs: DataFrame, max_len: int | None = None) -> DataFrame:
    """(run, words): every distinct run of ``runs`` (run) cut into words."""
    if max_len is None:
        max_len = costs.agg(F.max(F.length("word"))).first()[0] or 1
    runs = runs.select("run").distinct()
    salt = F.pmod(F.xxhash64("run"), F.lit(SALTS)).cast("int").alias("salt")
    grams = _substrings(runs, max_len, "run").select("run", "start", "len", F.col("gram").alias("word"), salt)
    listed = costs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    arcs = (grams.join(listed, ["word", "salt"]).groupBy("run")
            .agg(F.collect_list(F.struct("start", "len", "cost")).alias("arcs")))    # at most max_len a character
    whole = runs.join(arcs, "run", "left").select("run", "arcs")

    def paths(batches):
        for b in batches:
            texts, arcs = b.column("run").to_pylist(), b.column("arcs")
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            count = pc.fill_null(pc.list_value_length(arcs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, stop = arcs.flatten(), np.cumsum(count)
            start, size, cost = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            ends, low = [], 0
            while low < len(texts):
                if lengths[low] > TOGETHER:
                    of = slice(stop[low] - count[low], stop[low])
                    ends.append(best_path(int(lengths[low]), zip(start[of].tolist(), size[of].tolist(), cost[of].tolist())))
                    low += 1
                    continue
                high = low + 1
                cells = lengths[low] + 1
                while high < len(texts) and lengths[high] <= TOGETHER and (cells + lengths[high] + 1) * max_len <= CELLS:
                    cells += lengths[high] + 1
                    high += 1
                of = slice(stop[low] - count[low], stop[high - 1])
                ends += best_paths(lengths[low:high], np.repeat(np.arange(high - low), count[low:high]), start[of], size[of], cost[of])
                low = high
            words = [[t[a:z] for a, z in zip([0, *e], e)] for t, e in zip(texts, ends)]
            yield pa.record_batch([b.column("run"), pa.array(words, pa.list_(pa.string()))], names=["run", "words"])

    return whole.mapInArrow(paths, "run string, words array<string>")


def dictionary_tokens(posts: DataFrame, dictionary: DataFrame | None = None, stop_words=None, min_len: int = 2, **learn) -> DataFrame:
    """T1 by dictionary: (id, term, tf).  ``dictionary`` (word, freq) is given or
    learned from the posts (see ``learn_dictionary``); terms shorter than
    ``min_len`` and stop words are left out as in ``tokenize``."""
    stop = STOP_WORDS_TOPIC if stop_words is None else list(stop_words)
    own = cut(post_runs(posts))
    counts = own.groupBy("run").agg(F.sum("n").alias("n"))
    costs = cut(word_costs(learn_dictionary(counts, **learn) if dictionary is None else dictionary))
    words = cut(segment_runs(counts, costs).select("run", F.filter("words", lambda w: (F.length(w) >= min_len) & ~w.isin(*stop)).alias("words"))
                .filter("size(words) > 0"))
    return (own.join(words, "run").select("id", F.explode("words").alias("term"), "n")
            .groupBy("id", "term").agg(F.sum("n").alias("tf")))
