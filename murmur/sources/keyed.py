"""Posts stored by key (S3-S5, ST1): a table whose writes touch few files.

Rows lie in buckets by the hash of their key.  A write puts its rows under
``data/d<version>/_bucket=<b>`` and then names, in ``manifest/v=<version>``,
the versions that make up every bucket; a reader takes the newest manifest that
was committed.  So a write is seen whole or not at all, a failed one leaves
nothing that a reader finds, and buckets that it does not touch keep their
files.  Every version has a Bloom filter for each of its buckets: a batch reads
stored keys only in buckets that may hold one of its own.

A bucket that has grown by MOST_PIECES writes is rewritten as one.  There is
one writer at a time; the manifest folder of a version can be written once, so
of two writers one fails.  Insert-ignore takes a null part of a key as a value like
any other; an upsert never matches it, as in the batch job."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, path_exists, remove_path
from .ingest import KEY, first_rows, ingest_upsert

BUCKETS = 16           # about one for every ten million stored rows
MOST_PIECES = 8
FILTER_WORDS = 2048        # 64-bit words of the filter of one bucket and version
FILTER_BITS = 4            # bits a key sets, in one word
FILE_ROWS = 1_000_000      # about so many rows a file


class KeyedTable:
    """Rows by unique key under ``path`` (a shared folder)."""

    key = KEY

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # ------------------------------------------------------------- versions

    def version(self) -> int | None:
        """The newest committed version."""
        folder = f"{self.path}/manifest"
        if not path_exists(self.spark, folder):
            return None
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [int(m.group(1)) for f in fs.listStatus(p) if (m := re.fullmatch(r"v=(\d+)", f.getPath().getName()))]
        return max((v for v in found if path_exists(self.spark, f"{folder}/v={v}/_SUCCESS")), default=None)

    def pieces(self) -> dict[int, list[int]]:
        """The versions that make up each bucket (one small row for each)."""
        v = self.version()
        if v is None:
            return {}
        out: dict[int, list[int]] = {}
        for r in self.spark.read.parquet(f"{self.path}/manifest/v={v}").filter("bucket >= 0").collect():
            out.setdefault(r.bucket, []).append(r.version)
        return out

    def mark(self) -> int | None:
        """The mark of the last write that had one (a stream's epoch)."""
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.path}/manifest/v={v}").agg(F.max("mark")).first()[0]

    def _commit(self, version: int, pieces: dict[int, list[int]], mark: int | None) -> None:
        mark = self.mark() if mark is None else mark
        rows = [(b, v, mark) for b, vs in pieces.items() for v in vs] or [(-1, -1, mark)]
        (self.spark.createDataFrame(rows, "bucket int, version long, mark long").coalesce(1)
         .write.mode("errorifexists").parquet(f"{self.path}/manifest/v={version}"))

    # ---------------------------------------------------------------- reading

    def _hash(self) -> Column:
        return F.xxhash64(*self.key)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(self._hash(), F.lit(self.buckets)).cast("int"))

    def _read(self, pieces: dict[int, list[int]], kind: str = "data") -> DataFrame | None:
        by: dict[int, list[int]] = {}
        for b, versions in pieces.items():
            for v in versions:
                by.setdefault(v, []).append(b)
        out = None
        for v, bs in sorted(by.items()):
            base = f"{self.path}/{kind}/d{v}"
            part = self.spark.read.option("basePath", base).parquet(*[f"{base}/_bucket={b}" for b in sorted(bs)])
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def read(self) -> DataFrame:
        """All rows."""
        df = self._read(self.pieces())
        if df is None:
            raise FileNotFoundError(f"no rows under {self.path}")
        return df.drop("_bucket")

    # ---------------------------------------------------------------- filters

    def _word(self) -> Column:
        return F.pmod(F.xxhash64(self._hash(), F.lit(1)), F.lit(FILTER_WORDS)).cast("int")

    def _mask(self) -> Column:
        mask, h = F.lit(0).cast("long"), F.xxhash64(self._hash(), F.lit(2))
        for i in range(FILTER_BITS):
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"),
                                                  F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
        return mask

    def maybe_known(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` whose key the filters do not rule out."""
        bits = self._read(self.pieces(), "bloom")
        if bits is None:
            return batch.limit(0)
        bits = bits.select("_bucket", F.col("word").alias("_word"), "bits")
        asked = self._bucketed(batch).withColumn("_word", self._word()).withColumn("_mask", self._mask())
        hit = asked.join(bits, ["_bucket", "_word"]).filter(F.col("bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))
        return batch.join(hit.select(*[F.col(k).alias(f"_k_{k}") for k in self.key]).distinct(), self._same("_k_"), "left_semi")

    def _same(self, prefix: str) -> Column:
        on = F.lit(True)
        for k in self.key:
            on = on & F.col(k).eqNullSafe(F.col(prefix + k))
        return on

    # ---------------------------------------------------------------- writing

    def _write(self, rows: DataFrame, version: int) -> list[int]:
        """Write bucketed ``rows`` and their filters as a version; its buckets."""
        base = f"{self.path}/data/d{version}"
        files = max(1, math.ceil(rows.count() / FILE_ROWS / self.buckets))
        (rows.repartition(self.buckets * files, "_bucket", F.pmod(F.xxhash64(self._hash(), F.lit(3)), F.lit(files)))
             .write.mode("overwrite").partitionBy("_bucket").parquet(base))
        held = self.spark.read.schema(rows.schema).parquet(base)
        (held.select("_bucket", self._word().alias("word"), self._mask().alias("mask"))
             .groupBy("_bucket", "word").agg(F.bit_or("mask").alias("bits")).repartition("_bucket")
             .write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/bloom/d{version}"))
        return sorted(r[0] for r in held.select("_bucket").distinct().collect())    # at most ``buckets``

    def unknown(self, rows: DataFrame) -> DataFrame:
        """The rows (one a key) whose key is not stored.  Of the stored rows only
        the keys are read, in buckets where the filters find a likely match."""
        likely = cut(self.maybe_known(rows).select(*self.key))
        touched = [r[0] for r in self._bucketed(likely).select("_bucket").distinct().collect()]    # at most ``buckets``
        pieces = self.pieces()
        stored = self._read({b: pieces[b] for b in touched if b in pieces})
        if stored is None:
            return rows
        names = [F.col(k).alias(f"_k_{k}") for k in self.key]
        known = likely.join(stored.select(*names), self._same("_k_"), "left_semi")
        return rows.join(known.select(*names), self._same("_k_"), "left_anti")

    def append(self, rows: DataFrame, mark: int | None = None) -> None:
        """Add rows whose keys are new (see ``unknown``)."""
        version, pieces = (self.version() or 0) + 1, self.pieces()
        for b in self._write(self._bucketed(rows), version):
            pieces.setdefault(b, []).append(version)
        self._commit(version, pieces, mark)
        self.compact()

    def insert_ignore(self, batch: DataFrame, as_of=None, order: list[str] | None = None, mark: int | None = None) -> None:
        """S3: the first row of the batch for every key that is not stored yet.
        A mark that is not later than the last one's was written before: nothing
        is done (a stream's batch that is tried again)."""
        last = self.mark()
        if mark is not None and last is not None and mark <= last:
            return
        self.append(cut(self.unknown(first_rows(self._read(self.pieces()), batch, as_of, order))), mark)

    def upsert(self, batch: DataFrame, update=("likes",), as_of=None, order: list[str] | None = None) -> None:
        """Insert new keys, replace the ``update`` columns of stored ones.  Only
        buckets that may hold a key of the batch are rewritten; the new rows of
        other buckets are added to them."""
        batch = cut(self._bucketed(batch))
        version, pieces = (self.version() or 0) + 1, self.pieces()
        touched = [r[0] for r in self._bucketed(self.maybe_known(batch)).select("_bucket").distinct().collect()]
        stored = self._read({b: pieces[b] for b in touched if b in pieces})
        inside = F.col("_bucket").isin(touched) if touched else F.lit(False)
        none = self._read(pieces)
        empty = (batch if none is None else none).limit(0).drop("_bucket")
        new = ingest_upsert(empty, batch.filter(~inside).drop("_bucket"), update, as_of, order)
        if stored is not None:
            new = new.unionByName(ingest_upsert(stored.drop("_bucket"), batch.filter(inside).drop("_bucket"), update, as_of, order))
        own = self._write(self._bucketed(cut(new)), version)
        for b in own:
            pieces[b] = [version] if b in touched else [*pieces.get(b, []), version]
        self._commit(version, pieces, None)
        self.compact()

    def compact(self, most: int = MOST_PIECES) -> None:
        """Rewrite the buckets of more than ``most`` pieces as one piece."""
        pieces = self.pieces()
        long = {b: vs for b, vs in pieces.items() if len(vs) > most}
        if long:
            version = self.version() + 1
            self._write(cut(self._read(long)), version)
            self._commit(version, pieces | {b: [version] for b in long}, None)

    def vacuum(self) -> None:
        """Remove the files of versions that the newest manifest does not name
        (once no reader of an older one is left)."""
        named = {v for vs in self.pieces().values() for v in vs}
        for v in range(1, (self.version() or 0) + 1):
            for kind in ("data", "bloom"):
                if v not in named and path_exists(self.spark, f"{self.path}/{kind}/d{v}"):
                    remove_path(self.spark, f"{self.path}/{kind}/d{v}")
