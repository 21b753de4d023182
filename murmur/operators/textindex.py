"""Substring search through an index (F1): posting lists of character grams.

The index holds, for every string of one to three characters, the posts whose
lower-cased text contains it.  A keyword of three characters or more is in a
text only if all its three-character strings are; a shorter one is an entry of
its own.  Posting lists are kept by block of ids, so the list of a string that
is in every post is many rows of bounded size; texts are stored by the same
blocks.  A search reads the lists of its own strings (the bucket and the row
groups that hold them), counts for each post how many it is on, and reads only
the blocks of texts with candidates, to check the keyword itself.

Grams are exact: three code points of 21 bits in one long, no hash.  Case is
ignored as in the plain search; blank keywords find nothing; null texts are
on no list; posts without id are left out, as no result can name them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

WIDTH = 100_000      # ids of one block
BUCKETS = 64         # folders that the posting lists are dealt to
LISTED = 1_000       # grams or blocks up to which a search names them to the reader
SLICE = 1 << 20      # characters turned into grams together


def grams_of(code: np.ndarray, sizes=(1, 2, 3)) -> np.ndarray:
    """The distinct strings of ``sizes`` characters of a text given by code points."""
    code = code.astype(np.int64) + 1
    out = []
    for n in sizes:
        if len(code) >= n:
            g = code[: len(code) - n + 1].copy()
            for k in range(1, n):
                g |= code[k: len(code) - n + 1 + k] << (21 * k)
            out.append(np.unique(g))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


@dataclass
class TextIndex:
    """An index under ``path`` whose lists were dealt to ``buckets`` folders."""
    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")


def build_text_index(posts: DataFrame, path: str, id_col: str = "id", text_col: str = "content",
                     width: int = WIDTH, buckets: int = BUCKETS) -> TextIndex:
    """Write the index of ``posts`` under ``path``."""
    spark = posts.sparkSession
    index = TextIndex(spark, path.rstrip("/"), buckets)
    texts = (posts.select(F.col(id_col).cast("long").alias("id"), F.lower(text_col).alias("text"))
             .filter("id IS NOT NULL AND text <> ''").withColumn("block", F.floor(F.col("id") / width)))
    (texts.repartition("block", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("block", "id")
          .write.mode("overwrite").partitionBy("block").parquet(f"{index.path}/texts"))

    def lists(batches):
        for b in batches:
            ids, blocks = b.column("id").to_numpy(), b.column("block").to_numpy()
            low, size = 0, np.cumsum(pc.utf8_length(b.column("text")).to_numpy())
            while low < b.num_rows:
                high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + SLICE, "right")))
                own = [grams_of(_codes(t)) for t in b.column("text").slice(low, high - low).to_pylist()]
                gram = np.concatenate(own)
                row = np.repeat(np.arange(low, high), [len(g) for g in own])
                order = np.lexsort((ids[row], blocks[row], gram))
                gram, row = gram[order], row[order]
                block = blocks[row]
                start = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])]))
                yield pa.record_batch([pa.array(gram[start]), pa.array(block[start]),
                                       pa.ListArray.from_arrays(pa.array(np.append(start, len(row)).astype(np.int32)), pa.array(ids[row]))],
                                      names=["gram", "block", "ids"])
                low = high

    stored = index.texts().select("id", F.col("block").cast("long").alias("block"), "text")
    merged = (stored.mapInArrow(lists, "gram long, block long, ids array<long>")
              .groupBy("gram", "block").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))  # a block's ids
              .withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")))
    (merged.repartition("bucket", F.pmod(F.col("block"), F.lit(16))).sortWithinPartitions("bucket", "gram", "block")
           .write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/lists"))
    return index


def keyword_grams(keywords: DataFrame) -> DataFrame:
    """(keyword, word, gram, grams): the strings that a text must hold for each
    of the keywords (``word``: in lower case; ``grams``: how many)."""
    words = (keywords.select("keyword", F.lower("keyword").alias("word")).filter("trim(word) <> ''").distinct())

    def split(batches):
        for b in batches:
            word = b.column("word").to_pylist()
            own = [grams_of(_codes(w), (min(3, len(w)),)) for w in word]
            row = np.repeat(np.arange(len(own)), [len(g) for g in own])
            yield pa.record_batch([b.column("keyword").take(pa.array(row)), b.column("word").take(pa.array(row)),
                                   pa.array(np.concatenate(own) if own else np.zeros(0, dtype=np.int64)),
                                   pa.array(np.array([len(own[r]) for r in row], dtype=np.int64))],
                                  names=["keyword", "word", "gram", "grams"])

    return words.mapInArrow(split, "keyword string, word string, gram long, grams long")


def candidates(index: TextIndex, grams: DataFrame) -> DataFrame:
    """(keyword, word, block, id): the posts on the lists of all grams of a keyword."""
    lists = index.lists()
    wanted = grams.select("gram").distinct().limit(LISTED + 1).collect()
    if len(wanted) <= LISTED:       # named to the reader: folders and row groups without them are skipped
        lists = lists.filter(F.col("gram").isin([r.gram for r in wanted]))
        folder = F.pmod(F.xxhash64("gram"), F.lit(index.buckets)).cast("int")
        lists = lists.filter(F.col("bucket").isin([r[0] for r in grams.select(folder).distinct().collect()]))
    hits = grams.join(lists.select("gram", "block", "ids"), "gram").select("keyword", "word", "grams", "block", F.explode("ids").alias("id"))
    return (hits.groupBy("keyword", "word", "grams", "block", "id").agg(F.count(F.lit(1)).alias("n"))
            .filter("n = grams").select("keyword", "word", "block", "id"))


def search_indexed(index: TextIndex, keywords: DataFrame) -> DataFrame:
    """(keyword, id): the posts whose text contains each keyword of the table
    ``keywords`` (keyword), ignoring case."""
    found = cut(candidates(index, keyword_grams(keywords)))
    blocks = found.select("block").distinct().limit(LISTED + 1).collect()
    texts = index.texts()
    if len(blocks) <= LISTED:
        texts = texts.filter(F.col("block").isin([r.block for r in blocks]))
    return (found.join(texts, ["block", "id"]).filter(F.contains("text", F.col("word"))).select("keyword", "id").distinct())
