"""Shared by the tests of this folder."""
from pyspark.sql import functions as F

CLASH = ["doc", "fp", "component_id", "uid", "a", "b", "key", "seg", "pack", "lo", "hi", "size", "shard", "row", "g", "n",
         "rank", "piece", "line", "code", "start", "length", "c", "t", "pos", "block", "_m_bytes"]


def extra(df):
    """``df`` with columns whose names the operators use inside."""
    for name in CLASH:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(1))
    return df
