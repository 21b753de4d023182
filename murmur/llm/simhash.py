"""SimHash near-duplicate detection with pigeonring filtering (operator 9).

Fingerprint: A-Z are lower-cased, words are runs without white space, shingles
are n consecutive words joined by one space (repeats included; a text with
fewer words is one shingle, a text without words has fingerprint zero).  A bit
is set if it is set in over half of the shingles' XXH64 (seed 42).

Candidates: the 64 bits form a ring of four 16-bit segments.  If two
fingerprints differ in at most 3 bits, the pigeonring principle (Qin and Xiao,
VLDB 2018) gives a segment from which every chain of l consecutive segments
has at most floor(l * 3 / 4) differences: 0, 1, 2, 3.  So the first segment is
equal, and of the two halves of the second, which may hold one difference,
one is equal too: 24 equal bits, found under one of 8 keys.  The chain budgets
prune what shares a key before the full Hamming check.

Edge cases: a null text counts as empty; rows without a doc_id get a
fingerprint and link the documents that are close to them, but have a null
component themselves; repeated rows are in one group (their fingerprints are
equal); empty input gives no rows; other columns of the input are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents_of, input_tasks
from .graph import components
from .textvec import text_batches

SHINGLE_WORDS = 3
MAX_BITS = 3
BLOCK = 2048    # fingerprints of one key compared at a time; larger keys are split into pairs of blocks


def _fingerprint(text, n: int) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= n:
        return h(norm, 42)
    gap = np.flatnonzero(np.frombuffer(norm, dtype=np.uint8) == 32)
    start = np.concatenate(([0], gap + 1))[:len(words) - n + 1].tolist()
    end = np.concatenate((gap, [len(norm)]))[n - 1:].tolist()
    hashes = np.array([h(norm[a:b], 42) for a, b in zip(start, end)], dtype="<u8")
    count = np.zeros(64, dtype=np.int64)
    for p in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[p:p + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int32)
    bits = (2 * count > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long): the 64-bit fingerprint as a signed long."""
    def run(batches):
        for ids, texts in text_batches(batches, 2, 1):
            fp = np.array([_fingerprint(t, shingle_words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fp)], names=["doc_id", "fp"])

    return input_tasks(documents_of(docs, id_col, text_col)).mapInArrow(run, "doc_id long, fp long")


_M16 = np.uint64(0xFFFF)


def _linked(x: np.ndarray, y: np.ndarray, start: np.ndarray, max_bits: int) -> np.ndarray:
    """Pairs whose chains from segment ``start`` stay within budget, and whose
    Hamming distance is at most ``max_bits``."""
    d = x ^ y
    ok = np.ones(d.shape, dtype=bool)
    total = np.zeros(d.shape, dtype=np.uint8)
    for step in range(4):
        shift = ((start + step) % 4).astype(np.uint64) * np.uint64(16)
        total = total + np.bitwise_count((d >> shift) & _M16)
        ok &= total <= (step + 1) * max_bits // 4
    return ok


def _forest(fps: np.ndarray, other: np.ndarray | None, start: int, max_bits: int) -> list[tuple[int, int]]:
    """Edges that connect what is linked within ``fps`` (or between ``fps`` and
    ``other``): a spanning forest, so at most one edge for each fingerprint."""
    out = []
    if other is None:
        left = fps
        while len(left):
            front, left = [left[0]], left[1:]
            while front and len(left):
                x = front.pop()
                hit = _linked(left, x, np.array(start), max_bits)
                found = left[hit]
                out += [(int(x), int(y)) for y in found]
                front += list(found)
                left = left[~hit]
        return out
    sides = [fps, other]
    while len(sides[0]):
        front, sides[0] = [(0, sides[0][0])], sides[0][1:]
        while front:
            side, x = front.pop()
            far = sides[1 - side]
            hit = _linked(far, x, np.array(start), max_bits)
            found = far[hit]
            out += [(int(x), int(y)) for y in found]
            front += [(1 - side, y) for y in found]
            sides[1 - side] = far[~hit]
    return out


def _keyed(fps: DataFrame) -> DataFrame:
    """(start, key, fp): 8 rows for each fingerprint, one for each segment that
    a chain can start from and each half of the segment after it."""
    rows = []
    for s in range(4):
        seg = F.shiftrightunsigned("fp", 16 * s).bitwiseAND(F.lit(0xFFFF))
        for half in range(2):
            at = (16 * (s + 1) + 8 * half) % 64
            piece = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit(0xFF))
            rows.append(F.struct(F.lit(s).cast("byte").alias("start"),
                                 (F.shiftleft(seg, 9) + F.shiftleft(piece, 1) + F.lit(half)).cast("int").alias("key")))
    return fps.select("fp", F.explode(F.array(*rows)).alias("k")).select("k.start", "k.key", "fp")


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a long, b long) edges between distinct fingerprints that differ in at
    most ``max_bits`` bits, enough to connect all that are linked.

    ``fps``: distinct (fp).  Keys with more than BLOCK fingerprints are cut into
    blocks by hash and every pair of blocks is a unit of its own, so no task
    holds an unbounded key; a unit returns a spanning forest, so a dense group
    gives edges in proportion to its size."""
    if max_bits != 3:
        raise ValueError("the key layout is made for 3 differing bits")
    keyed = _keyed(fps)
    many = (keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                 .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    k = keyed.join(many, ["start", "key"]).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    k = k.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = k.select("start", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
                     "mine", "fp")
    parts = units.repartition("start", "key", "lo", "hi").sortWithinPartitions("start", "key", "lo", "hi", "fp")

    def run(batches):
        held = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            # the last unit may go on in the next batch
            new = np.ones(len(cols[0]), dtype=bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:4]])
            at = np.flatnonzero(new)
            held = [c[at[-1]:] for c in cols]
            yield from _units([c[:at[-1]] for c in cols], at, max_bits)
        if held is not None and len(held[0]):
            yield from _units(held, np.array([0, len(held[0])]), max_bits)

    return parts.mapInArrow(run, "a long, b long")


def _units(cols, at, max_bits):
    """Edges of whole units; ``at``: their starts, and the end."""
    if len(at) < 2:
        return
    start, fp, mine, lo, hi = cols[0], cols[5].view(np.uint64), cols[4], cols[2], cols[3]
    size = np.diff(at)
    a, b = [], []
    small = size <= 8
    first, n = at[:-1][small], size[small]
    for gap in range(1, 8):         # small units: all their pairs, many units at a time
        for off in range(0, 8 - gap):
            pick = first[n > off + gap] + off
            if len(pick):
                x, y, s = fp[pick], fp[pick + gap], start[pick].astype(np.int64)
                ok = _linked(x, y, s, max_bits) & ((lo[pick] == hi[pick]) | (mine[pick] != mine[pick + gap]))
                a.append(x[ok])
                b.append(y[ok])
    for i in np.flatnonzero(~small):
        p, q = at[i], at[i + 1]
        f, m = fp[p:q], mine[p:q]
        e = (_forest(f, None, int(start[p]), max_bits) if lo[p] == hi[p]
             else _forest(f[m == lo[p]], f[m == hi[p]], int(start[p]), max_bits))
        if e:
            e = np.array(e, dtype=np.uint64)
            a.append(e[:, 0])
            b.append(e[:, 1])
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def simhash_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, fingerprint as 16 hexadecimal digits,
    component_id = smallest doc_id reachable over links, links included that
    lead over other documents).  Equal fingerprints are one node of the graph,
    so copies cost one row each and no pairs."""
    fps = cut(fingerprints(docs, shingle_words, id_col, text_col))
    node = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = components(links(node.select("fp"), max_bits).distinct()).withColumnRenamed("node", "fp")
    # a component is named by a fingerprint first: rows without doc_id link, too, but name nothing
    member = node.join(comp, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = member.groupBy("component").agg(F.min("least").alias("component_id"))
    label = member.select("fp", "component").join(named, "component").select("fp", "component_id")
    return (fps.join(label, "fp")
               .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                       F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")))


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` without the documents whose group has a smaller doc_id, repeated
    rows of one doc_id reduced to one (the first in the order of all columns);
    rows without doc_id stay.  Columns as in ``docs``."""
    first = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_m_keep")).distinct()
    w = Window.partitionBy("doc_id").orderBy(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.join(first, docs["doc_id"] == F.col("_m_keep"), "left_semi")
    one = held.withColumn("_m_rn", F.row_number().over(w)).filter("_m_rn = 1").drop("_m_rn")
    return one.unionByName(docs.filter("doc_id IS NULL"))


def keep_one_text(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Of each group of near-duplicate texts the row with the smallest doc_id
    (rows without one last, then by the text's SHA-256), of its repeated rows the
    first in the order of all columns.  Decided by doc_id and text: rows without
    doc_id are compared like any other, and different texts under one doc_id both
    stay unless they are near-duplicates.  Columns as in ``docs``."""
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)

    def run(batches):
        for ids, texts in text_batches(batches, 2, 1):
            fp = np.array([_fingerprint(t, shingle_words) for t in texts], dtype=np.uint64).view(np.int64)
            own = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.string()), pa.array(fp)],
                                             names=["_m_id", "_m_first", "fp"])

    rows = cut(input_tasks(documents_of(docs)).mapInArrow(run, "_m_id long, _m_first string, fp long"))
    comp = components(links(cut(rows.select("fp").distinct()), max_bits).distinct()).withColumnRenamed("node", "fp")
    place = F.struct(F.col("_m_id").isNull().alias("nameless"), "_m_id", "_m_first")
    first = (rows.groupBy("fp").agg(F.min(place).alias("p")).join(comp, "fp", "left")
                 .groupBy(F.coalesce("component", "fp").alias("group")).agg(F.min("p").alias("p")).select("p._m_id", "p._m_first"))
    held = docs.withColumn("_m_sha", sha)
    held = held.join(first, held["doc_id"].cast("long").eqNullSafe(F.col("_m_id")) & (F.col("_m_sha") == F.col("_m_first")), "left_semi")
    w = Window.partitionBy("doc_id", "_m_sha").orderBy(*[F.col(f"`{c}`") for c in docs.columns])
    return held.withColumn("_m_rn", F.row_number().over(w)).filter("_m_rn = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
