"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut  # a Parquet table in the session's shared checkpoint folder

__all__ = ["cut", "read", "documents_of", "input_tasks"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_m_id long, _m_text string): the two columns an operator works on, under
    names that no other column of the input can clash with."""
    return docs.select(docs[id_col].cast("long").alias("_m_id"), docs[text_col].cast("string").alias("_m_text"))


def input_tasks(df: DataFrame, least: int = 1) -> DataFrame:
    """Spread a scan that has fewer splits than the session has cores (one
    small file), so that a Python pass over it is not one task."""
    want = max(least, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def hash_bucket(cols, n: int):
    """0..n-1 by hash: the salt of a large key."""
    return F.pmod(F.xxhash64(*cols), F.lit(n))
