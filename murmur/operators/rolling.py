"""Rolling sums over a time axis by distributed prefix sums (W2, ST4).

A minute's counts enter a window at that minute and leave it ``window`` minutes
later: two signed rows, whatever the window's length.  Their running total is
the window's sum.  Running totals are taken inside blocks of the time axis, and
each block starts from the total of the blocks before it (one row a block), so
no task walks the whole axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BLOCK_MINUTES = 7 * 24 * 60
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def rolling_sums(per_minute: DataFrame, window_minutes: int, block_minutes: int = BLOCK_MINUTES) -> DataFrame:
    """For ``per_minute`` (minute timestamp_ntz, counts): the counts of the
    ``window_minutes`` minutes that end with each minute, where the first of them
    is not zero."""
    names = [c for c in per_minute.columns if c != "minute"]
    at = F.timestamp_diff("MINUTE", F.expr(_EPOCH), F.col("minute"))
    enter = per_minute.select(at.alias("m"), *names)
    leave = enter.select((F.col("m") + window_minutes).alias("m"), *[(-F.col(c)).alias(c) for c in names])
    steps = cut(enter.unionByName(leave).groupBy("m").agg(*[F.sum(c).alias(c) for c in names])
                .withColumn("block", F.floor(F.col("m") / block_minutes)))
    inside = Window.partitionBy("block").orderBy("m")
    order = Window.orderBy("block")     # one row a block
    blocks = (steps.groupBy("block").agg(F.min("m").alias("first"), *[F.sum(c).alias(c) for c in names])
              .select("block", F.lead("first").over(order).alias("then"),
                      *[F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{c}") for c in names]))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    runs = (steps.select("block", "m", F.lead("m").over(inside).alias("next"), *[F.sum(c).over(upto).alias(c) for c in names])
            .join(blocks, "block")
            .select("m", F.coalesce("next", "then").alias("next"), *[(F.col(c) + F.col(f"_{c}")).cast("long").alias(c) for c in names]))
    return (runs.filter((F.col(names[0]) != 0) & F.col("next").isNotNull())
            .select(F.explode(F.sequence(F.col("m"), F.col("next") - 1)).alias("m"), *names)
            .select(F.expr(f"timestampadd(MINUTE, m, {_EPOCH})").alias("minute"), *names))
