"""Token-id files in blocks of an adaptive range coder (operator 5).

``write_tokens`` sorts the documents by doc_id over the cluster, encodes every
whole text, and writes the ids in that order into part files of blocks; each
block names its documents, is coded from an empty model (see rangecoder) and
has a checksum, so a block can be read alone and damage stays in it.
``read_tokens`` reads the files back with any file system that Spark reads.

A part file is a sequence of records, each followed by a line feed:
    "MTF1", documents m (u32), bytes of the table (u32), table, coded block
and the table holds, for its m entries, doc_id (i64), "doc_id is null" (u8),
ids in this block (u32), "goes on in the next block" (u8).  Numbers are
little-endian.

Edge cases: a null or empty text is the end id alone; rows without doc_id come
first; repeated rows are stored as often as they come; an empty table gives
files without blocks and no rows; other columns of the input are ignored."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rangecoder
from .common import documents_of
from .tokens import default_tokenizer, encoder, slices

MAGIC = b"MTF1"
BLOCK_IDS = 1 << 21         # ids of a block, at most
BLOCKS_PER_FILE = 16


def _record(table: list, ids: np.ndarray) -> bytes:
    doc, null, n, more = (np.array(c) for c in zip(*table))
    head = doc.astype("<i8").tobytes() + null.astype("u1").tobytes() + n.astype("<u4").tobytes() + more.astype("u1").tobytes()
    return MAGIC + struct.pack("<II", len(table), len(head)) + head + rangecoder.encode(ids)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write the ids of all texts to ``path``, in ascending doc_id order over
    the part files and inside them.  ``tokenizer``: a byte-level BPE file of the
    tokenizers library, at the same place on every executor."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches):
        enc = encoder(tokenizer)
        table, parts, size = [], [], 0
        for ids_col, texts in slices(batches):
            ids, n = enc.encode(texts)
            at = np.concatenate(([0], np.cumsum(n)))
            for i, doc in enumerate(ids_col.to_pylist()):
                lo, hi = int(at[i]), int(at[i + 1])
                while lo < hi:
                    take = min(hi - lo, BLOCK_IDS - size)
                    table.append((doc or 0, doc is None, take, lo + take < hi))
                    parts.append(ids[lo:lo + take])
                    size += take
                    lo += take
                    if size == BLOCK_IDS:
                        yield _row(_record(table, np.concatenate(parts)))
                        table, parts, size = [], [], 0
        if table:
            yield _row(_record(table, np.concatenate(parts)))

    d = documents_of(docs, id_col, text_col)
    ordered = d.repartitionByRange("_m_id").sortWithinPartitions("_m_id")
    (ordered.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value"))
            .write.mode("overwrite").option("lineSep", "\n").option("maxRecordsPerFile", BLOCKS_PER_FILE).text(path))


def _row(block: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])


def _records(data: bytes):
    """(table columns, ids) of every record of one file."""
    at = 0
    while at < len(data):
        if data[at:at + 4] != MAGIC:
            raise ValueError("not a token file")
        m, size = struct.unpack_from("<II", data, at + 4)
        p = at + 12
        doc = np.frombuffer(data, "<i8", m, p)
        null = np.frombuffer(data, "u1", m, p + 8 * m).astype(bool)
        n = np.frombuffer(data, "<u4", m, p + 9 * m).astype(np.int64)
        more = np.frombuffer(data, "u1", m, p + 13 * m).astype(bool)
        p += size
        body = rangecoder.block_size(data, p)
        yield doc, null, n, more, rangecoder.decode(data[p:p + body])
        at = p + body + 1


def read_tokens(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """The documents of the files, one row per piece (one piece unless a text
    goes over a block): (part, file, place, doc_id, n_tokens, goes_on, and
    ids_crc32 or, without ``digest``, ids array<int>)."""
    names = ["part", "file", "place", "doc_id", "n_tokens", "goes_on"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches):
        for b in batches:
            for part, file, content in zip(*(b.column(k).to_pylist() for k in range(3))):
                place = 0
                for doc, null, n, more, ids in _records(content):
                    at = np.concatenate(([0], np.cumsum(n)))
                    cols = [np.full(len(doc), part), np.full(len(doc), file), np.arange(place, place + len(doc)),
                            pa.array(doc, mask=null), n, more]
                    place += len(doc)
                    if digest:
                        raw = memoryview(ids.astype("<u4").tobytes())
                        last = pa.array([zlib.crc32(raw[4 * at[i]:4 * at[i + 1]]) for i in range(len(doc))], pa.int64())
                    else:
                        last = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) if not isinstance(c, pa.Array) else c
                                                      for c, k in zip(cols, kinds)] + [last],
                                                     names=names + ["ids_crc32" if digest else "ids"])

    files = (spark.read.format("binaryFile").load(path)
                  .select(F.regexp_extract("path", r"part-(\d+)-", 1).cast("int").alias("part"),
                          F.regexp_extract("path", r"-c(\d+)\.", 1).cast("int").alias("file"), "content"))
    return files.mapInArrow(run, "part int, file int, place long, doc_id long, n_tokens long, goes_on boolean, "
                                 + ("ids_crc32 long" if digest else "ids array<int>"))


def _times(m, v):
    out = 0
    for row in m:
        if v & 1:
            out ^= row
        v >>= 1
    return out


def crc32_join(first: int, second: int, second_bytes: int) -> int:
    """crc32 of two strings one after the other from the crc32 of each: the
    first is moved past ``second_bytes`` zero bytes by squaring the one-bit
    shift over GF(2)."""
    step = [0xEDB88320] + [1 << i for i in range(31)]     # one zero bit
    n = 8 * second_bytes
    while n:
        if n & 1:
            first = _times(step, first)
        step = [_times(step, row) for row in step]
        n >>= 1
    return first ^ second


def document_digests(pieces: DataFrame) -> DataFrame:
    """Per document of ``read_tokens``: (doc_id, start = ids of all documents
    before it, n_tokens, ids_crc32)."""
    # where each file starts: totals by part, then inside the part
    files = pieces.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    w = Window.partitionBy("part").orderBy("file")
    files = (files.withColumn("inside", F.sum("n").over(w) - F.col("n")).join(before, "part")
                  .select("part", "file", (F.col("inside") + F.col("before")).alias("base")))
    own = Window.partitionBy("part", "file").orderBy("place")
    rows = (pieces.withColumn("local", F.sum("n_tokens").over(own) - F.col("n_tokens")).join(files, ["part", "file"])
                  .withColumn("start", F.col("base") + F.col("local")))
    # pieces of one text: all but the last go on; a text starts after one that does not
    order = Window.partitionBy("part").orderBy("start")
    rows = rows.withColumn("head", ~F.coalesce(F.lag("goes_on").over(order), F.lit(False)))
    whole = rows.filter("head AND NOT goes_on").select("doc_id", "start", "n_tokens", "ids_crc32")
    rest = rows.filter("NOT head OR goes_on").withColumn(
        "text_start", F.max(F.when(F.col("head"), F.col("start"))).over(order))

    @F.udf("long")
    def joined(crcs):
        out = 0
        for _, n, crc in sorted(crcs):
            out = crc32_join(out, crc, 4 * n)
        return out

    cut = (rest.groupBy("part", "text_start").agg(
        F.first("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"),
        F.collect_list(F.struct("start", "n_tokens", "ids_crc32")).alias("crcs"))
        .select("doc_id", F.col("text_start").alias("start"), "n_tokens", joined("crcs").alias("ids_crc32")))
    return whole.unionByName(cut)
