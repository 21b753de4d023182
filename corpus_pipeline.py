"""Corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark
decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that the
stage before it kept; its result is written as Parquet in the shared folder and
read again as the next one's documents.  All but the last return the columns of
documents; the last returns the packed pieces.

Stages and odd rows: null and empty texts fail the quality rules; rows without
doc_id go through every stage (they form no group, and are dropped as
contaminated only if a row without doc_id is); repeated rows are reduced to one
by the near-duplicate stage; columns beside doc_id, text and n_chars are carried
through untouched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmur.llm import decontaminate, lines, packing, quality, simhash
from murmur.llm.common import cut, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and repetition rules keep."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are similar to an earlier line."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest doc_id."""
    return simhash.keep_one_text(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_rows(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]

# XXH64, byte-pair encoding and packing have no SQL form; tests/llm holds the
# pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
