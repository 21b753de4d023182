"""Exact deduplication by two-pass Bloom filtering (operator 13).

Texts are equal if they are identical without space and \\x09-\\x0D.  Pass one
puts a 64-bit hash of every normalised text into a Bloom filter that counts:
it keeps the bits set by two rows or more.  Pass two asks it for every row; a
row with a bit that no other row set is unique and passes straight through.
Only the rows left, the copies and a fraction of a per cent of the others,
are shuffled and compared by SHA-256.

The filter is blocked: a hash sets BITS bits of one 64-bit word, so a row asks
for one word.  It has KEY_BITS bits a row and travels as a broadcast of at most
FILTER_WORDS words (32 MB).  More rows than that allows are taken in parts by
hash, each with a filter of its own, so no size of the table grows the
broadcast or the share of rows that pass in vain.

Hot groups: a group of copies is reduced by salted keys first (copies of one
text meet in the map tasks, then in SALTS pieces, then as at most SALTS rows),
and its verdict goes back to the copies by the same salted keys; no task sees a
whole group.  DataFrame functions only.

Edge cases: a null text is empty, and empty texts are equal to each other and
to texts of white space only; rows without doc_id take part, and stay only if
no copy with as many code points has an id; repeated rows are copies, one of
them stays; empty input gives no rows; other columns are ignored by the report
and carried through by ``keep_one``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import cut, documents_of

BITS = 4                  # bits a hash sets, all in one word
KEY_BITS = 16             # filter bits for each row
FILTER_WORDS = 1 << 22    # the largest filter: 32 MB
BLOCK_WORDS = 1 << 10     # words of the filter in one row of the broadcast table
SALTS = 1024

_SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without space and \\x09-\\x0D; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _SPACES, "")


def _bits(h: Column, of: int) -> Column:
    """Bit number ``of`` (0 .. BITS - 1) that a hash sets in its word."""
    return F.shiftrightunsigned(h, 6 * of).bitwiseAND(F.lit(63)).cast("int")


def _word(h: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(1)), F.lit(words))


def _part(h: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(2)), F.lit(parts))


def plan_filter(rows: int, key_bits: int = KEY_BITS, most_words: int = FILTER_WORDS) -> tuple[int, int]:
    """(parts, words of a part's filter, whole blocks)."""
    need = max(1, math.ceil(rows * key_bits / 64))
    parts = math.ceil(need / most_words)
    blocks = math.ceil(need / parts / BLOCK_WORDS)
    return parts, blocks * BLOCK_WORDS


def bloom_bits(hashes: DataFrame, words: int, least: int = 2) -> DataFrame:
    """(block, bits: 1,024 longs): the bits that ``least`` rows of ``hashes``
    (h) or more have set.  Equal bits of one task meet before the shuffle, so
    copies of one text send one row a task and bit."""
    spark = hashes.sparkSession
    often = (hashes.select(_word(F.col("h"), words).alias("word"),
                           F.explode(F.array_distinct(F.array(*[_bits(F.col("h"), i) for i in range(BITS)]))).alias("bit"))
             .groupBy("word", "bit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
             .select("word", F.expr("shiftleft(1L, bit)").alias("mask")))
    every = spark.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    return (often.unionByName(every).groupBy("word").agg(F.bit_or("mask").alias("mask"))
            .groupBy(F.floor(F.col("word") / BLOCK_WORDS).cast("long").alias("block"))
            .agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).getField("mask").alias("bits")))


def flagged(rows: DataFrame, bits: DataFrame, words: int) -> DataFrame:
    """``rows`` (with h) and ``maybe``: false only if the filter lacks the hash."""
    word = _word(F.col("h"), words)
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), _bits(F.col("h"), i)))
    held = F.get(F.col("bits"), F.pmod(word, F.lit(BLOCK_WORDS)).cast("int"))
    return (rows.withColumn("block", F.floor(word / BLOCK_WORDS).cast("long"))
            .join(F.broadcast(bits), "block")    # at most FILTER_WORDS words
            .withColumn("maybe", held.bitwiseAND(mask) == mask).drop("block", "bits"))


def split_repeated(rows: DataFrame, key_bits: int = KEY_BITS, most_words: int = FILTER_WORDS) -> DataFrame:
    """A written table of ``rows`` (a written table with h) and ``maybe``: false
    only if no other row has this hash.  Parts are read from a copy sorted by
    part, so that each pass reads the pages of its own rows."""
    spark: SparkSession = rows.sparkSession
    parts, words = plan_filter(rows.count(), key_bits, most_words)
    if parts > 1:
        rows = cut(rows.withColumn("part", _part(F.col("h"), parts)).sortWithinPartitions("part"))
    path = scratch_path(spark, "bloom")
    for p in range(parts):
        own = rows.filter(F.col("part") == p).drop("part") if parts > 1 else rows
        bits = cut(bloom_bits(own.select("h"), words))
        flagged(own, bits, words).write.mode("overwrite").parquet(f"{path}/part={p}")
    return spark.read.parquet(path).drop("part")


def groups_of(copies: DataFrame) -> DataFrame:
    """(sha, salt, group_size, best): the size of every group of equal texts
    and the row that stays, for every salt that the group has; ``copies`` has
    sha, salt, size, doc_id and uid."""
    best = F.struct((-F.col("size")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")
    pieces = cut(copies.groupBy("sha", "salt").agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("best")))
    whole = pieces.groupBy("sha").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
    return pieces.select("sha", "salt").join(whole, "sha")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table the passes work on: uid, doc_id, size (code points of
    the text), sha (of the normalised text), h.  Texts are read once."""
    d = documents_of(docs, id_col, text_col)
    return cut(d.select(F.monotonically_increasing_id().alias("uid"), F.col("_m_id").alias("doc_id"),
                        F.length(F.coalesce("_m_text", F.lit(""))).cast("long").alias("size"),
                        F.unhex(F.sha2(normalised(F.col("_m_text")).cast("binary"), 256)).alias("sha"))
               .withColumn("h", F.xxhash64("sha")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 key_bits: int = KEY_BITS, most_words: int = FILTER_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256 (of the normalised text), n_chars (code points of the text)."""
    rows = split_repeated(digests(docs, id_col, text_col), key_bits, most_words)
    salt = F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")
    copies = rows.filter("maybe").withColumn("salt", salt)
    judged = (copies.join(cut(groups_of(copies)), ["sha", "salt"])
              .select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
                      (F.col("best.uid") == F.col("uid")).alias("kept"), "sha", "size"))
    alone = rows.filter("NOT maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                            F.lit(True).alias("kept"), "sha", "size")
    return alone.unionByName(judged).select("doc_id", "keep_id", "group_size", "kept",
                                            F.lower(F.hex("sha")).alias("text_sha256"), F.col("size").alias("n_chars"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts (the one that
    ``exact_groups`` keeps; of rows alike in id and code points, any one), all
    columns carried through.  A Bloom filter over the groups of two or more
    (one of at most FILTER_WORDS words) lets all other rows pass straight
    through; its hits are compared with their group by SHA-256."""
    groups = exact_groups(docs, id_col, text_col)
    stays = cut(groups.filter("kept AND group_size > 1")
                .select(F.col("text_sha256").alias("_m_sha"), F.col("doc_id").alias("_m_keep"), F.col("n_chars").alias("_m_most")))
    words = min(plan_filter(stays.count())[1], FILTER_WORDS)
    bits = cut(bloom_bits(stays.select(F.xxhash64("_m_sha").alias("h")), words, least=1))
    text = docs[text_col].cast("string")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_m_row"), docs[id_col].cast("long").alias("_m_id"),
                       F.length(F.coalesce(text, F.lit(""))).cast("long").alias("_m_size"),
                       F.sha2(normalised(text).cast("binary"), 256).alias("_m_sha")).withColumn("h", F.xxhash64("_m_sha"))
    rows = flagged(rows, bits, words)
    met = cut(rows.filter("maybe").join(stays, "_m_sha", "left")
              .filter("_m_most IS NULL OR (_m_most = _m_size AND _m_keep <=> _m_id)").select("_m_row", "_m_sha", "_m_most"))
    return (rows.filter("NOT maybe").select("_m_row")
            .unionByName(met.filter("_m_most IS NULL").select("_m_row"))
            .unionByName(met.filter("_m_most IS NOT NULL").groupBy("_m_sha").agg(F.first("_m_row").alias("_m_row")).select("_m_row"))
            .select("_m_row.*"))
