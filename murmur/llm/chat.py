"""Chat formatting with cumulative-snapshot collapse (operator 8).

Logs often hold a conversation several times, as it grew.  A conversation that
is a prefix of a longer one (same roles and texts, turn by turn) is dropped, of
equal ones the smallest conv_id stays; the rest is rendered turn by turn.

Rolling prefix hashes: the hash of the first k turns is the XOR of two 64-bit
hashes of (position, role, text) over them, so it is a running aggregate.
Positions and running hashes are made in two levels (blocks of turn numbers,
then turns inside a block), so a huge conversation is not one task's work.
Anti-joins of whole-conversation hashes against the distinct proper-prefix
hashes keep the maximal conversations; copies of a prefix are one row there.

Edge cases: turns of one number are ordered by role and text, nulls first;
repeated rows (all four values equal) count once; a null role or text is a value
of its own, rendered as an empty string; rows without conv_id are one
conversation (reported with a null id) and rows without turn come first in
theirs; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK_TURNS = 256       # turn numbers of one block
START, END = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
          text: str = "text") -> DataFrame:
    """(c, t, role, text, block, pos): distinct turns with their position (from
    1) in their conversation."""
    x = conversations.select(conversations[conv].cast("long").alias("c"), conversations[turn].cast("long").alias("t"),
                             conversations[role].cast("string").alias("role"),
                             conversations[text].cast("string").alias("text")).distinct()
    x = x.withColumn("block", F.floor(F.col("t") / F.lit(BLOCK_TURNS)))
    size = x.groupBy("c", "block").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("c").orderBy(F.col("block").asc_nulls_first())
    size = size.select(F.col("c").alias("c2"), F.col("block").alias("b2"), (F.sum("n").over(w) - F.col("n")).alias("before"))
    own = Window.partitionBy("c", "block").orderBy(F.col("t").asc_nulls_first(), F.col("role").asc_nulls_first(),
                                                   F.col("text").asc_nulls_first())
    x = x.withColumn("inside", F.row_number().over(own))
    return (x.join(size, x["c"].eqNullSafe(size["c2"]) & x["block"].eqNullSafe(size["b2"]))
             .select("c", "t", "role", "text", "block", (F.col("inside") + F.col("before")).alias("pos")))


def prefix_hashes(t: DataFrame) -> DataFrame:
    """(c, pos, h1, h2): 128-bit hash of the first ``pos`` turns."""
    known = F.concat(F.when(F.col("role").isNull(), F.lit("n")).otherwise(F.lit("r")),
                     F.when(F.col("text").isNull(), F.lit("n")).otherwise(F.lit("t")))
    t = t.select("c", "block", "pos", F.xxhash64("pos", "role", "text", known).alias("a"),
                 F.xxhash64(F.lit(7), "text", "pos", known, "role").alias("b"))
    sums = t.groupBy("c", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    w = (Window.partitionBy("c").orderBy(F.col("block").asc_nulls_first())
               .rowsBetween(Window.unboundedPreceding, -1))
    none = F.lit(0).cast("long")
    sums = sums.select(F.col("c").alias("c2"), F.col("block").alias("b2"), F.coalesce(F.bit_xor("a").over(w), none).alias("pa"),
                       F.coalesce(F.bit_xor("b").over(w), none).alias("pb"))
    own = Window.partitionBy("c", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("ra", F.bit_xor("a").over(own)).withColumn("rb", F.bit_xor("b").over(own))
    return (t.join(sums, t["c"].eqNullSafe(sums["c2"]) & t["block"].eqNullSafe(sums["b2"]))
             .select("c", "pos", F.col("ra").bitwiseXOR(F.col("pa")).alias("h1"),
                     F.col("rb").bitwiseXOR(F.col("pb")).alias("h2")))


def maximal(t: DataFrame) -> DataFrame:
    """(c, n): the conversations that are no prefix of another."""
    h = cut(prefix_hashes(t))
    last = h.groupBy("c").agg(F.max(F.struct("pos", "h1", "h2")).alias("e")).select("c", "e.*")
    key = ["pos", "h1", "h2"]
    one = last.groupBy(*key).agg(F.min("c").alias("c"))
    size = last.select(F.col("c").alias("c2"), F.col("pos").alias("n"))
    proper = (h.join(size, h["c"].eqNullSafe(size["c2"])).filter("pos < n").select(*key).distinct())
    return one.join(proper, key, "left_anti").select("c", F.col("pos").alias("n"))


def render(conversations: DataFrame, **names) -> DataFrame:
    """Maximal conversations in chat format, one row per turn: (conv_id,
    position, n_turns, role, rendered).  The rendered turns of a conversation in
    the order of position are its formatted text; ``conversation_texts`` joins
    them where one row per conversation is wanted."""
    t = cut(turns(conversations, **names))
    keep = maximal(t).withColumnRenamed("c", "c2")
    line = F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")),
                    F.lit(END + "\n"))
    return (t.join(keep, t["c"].eqNullSafe(keep["c2"]))
             .select(F.col("c").alias("conv_id"), F.col("pos").alias("position"), F.col("n").alias("n_turns"), "role",
                     line.alias("rendered")))


def conversation_texts(rendered: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text): one row per conversation, for conversations that
    fit into one row."""
    return (rendered.groupBy("conv_id", "n_turns")
                    .agg(F.sort_array(F.collect_list(F.struct("position", "rendered"))).alias("x"))
                    .select("conv_id", "n_turns", F.concat_ws("", F.col("x.rendered")).alias("text")))
