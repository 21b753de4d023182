"""Benchmark decontamination by size-partitioned MinHash containment (operator 4).

Texts are lower-cased (A-Z), words are runs without white space, shingles are
five consecutive words (a text of fewer words is one shingle, an empty one has
none).  A document is contaminated by a test item if it holds at least 80 % of
the item's distinct shingles.

The items are partitioned by their number of shingles (up to 2, 4, 8, ...).
An item's sketch is its k smallest shingle hashes (a bottom-k MinHash), with k
from the upper size u of its partition: k = u - ceil(t * u) + 1.  An item of m <= u
shingles of which a document holds t * m or more can lose at most m - ceil(t * m)
< k of them, so the document holds one of the k smallest: every true match is a
candidate, however long the document is, which a fixed number of MinHash bands
cannot promise when the item is a thousandth of the document.  Candidates are
verified by exact containment of the shingle texts.

The items are the stated queries; they are taken in blocks of bounded size, and
each block makes one pass over the documents, without a shuffle.

Edge cases: null or empty texts on either side match nothing; items without
item_id and documents without doc_id are compared and reported with null ids;
repeated rows give repeated pairs, once each; empty tables give no rows; other
columns are ignored."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, input_tasks
from .textvec import PolyHash, join_texts, mix64, text_batches, text_slices, word_hashes, word_spans

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
BLOCK_BYTES = 32 << 20      # item text of one block: the bound on what a pass ships to the tasks
SCHEMA = "doc_id long, item_id long, n_shingles int, n_found int, containment double"


def _needed(m: int, t: float) -> int:
    return math.ceil(t * m - 1e-9)


def _sketch_size(m: int, t: float) -> int:
    """From the upper size of the partition that holds m."""
    u = 1 << max(0, (m - 1).bit_length())
    return u - _needed(u, t) + 1


def _shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, of all of them if there are fewer."""
    k = min(n, len(words))
    if k == 0:
        return words
    out = words[:len(words) - k + 1].copy()
    for i in range(1, k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[i:len(words) - k + 1 + i])
    return out


def _shingle_texts(text: str, n: int) -> set:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


class _Items:
    """One block of test items: their shingles, and the sketch as a sorted array."""

    def __init__(self, rows, n, t, seed=5):
        self.n, self.t, self.poly = n, t, PolyHash(seed)
        self.ids, self.sets = [r[0] for r in rows], [_shingle_texts(r[1], n) for r in rows]
        hashes, owner = [], []
        for k, s in enumerate(self.sets):
            if s:
                h = np.sort(np.unique([self.hash(x) for x in s]))[:_sketch_size(len(s), t)]
                hashes.append(h)
                owner.append(np.full(len(h), k))
        h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        o = np.concatenate(owner) if owner else np.zeros(0, dtype=np.int64)
        order = np.argsort(h, kind="stable")
        self.keys, self.owner = h[order], o[order]
        self.bits = np.zeros(1 << 20, dtype=bool)       # first test, by 20 bits of the hash
        self.bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def hash(self, shingle: bytes):
        s, e = word_spans(shingle)
        return _shingle_hashes(word_hashes(shingle, s, e, self.poly), self.n)[0]

    def matches(self, ids, texts):
        data, at = join_texts(texts)
        data = data.lower()
        starts, ends = word_spans(data)
        words = word_hashes(data, starts, ends, self.poly)
        word_at = np.searchsorted(starts, at)
        found: dict[int, set] = {}
        h = _shingle_hashes(words, self.n) if len(words) >= self.n else words[:0]
        self._probe(h, np.searchsorted(word_at, np.arange(len(h)), "right") - 1, found,
                    lambda pos, doc: pos + self.n <= word_at[doc + 1])
        for doc in np.flatnonzero((np.diff(word_at) < self.n) & (np.diff(word_at) > 0)):  # one shingle
            self._probe(_shingle_hashes(words[word_at[doc]:word_at[doc + 1]], self.n), np.array([doc]), found,
                        lambda pos, doc: np.ones(len(pos), dtype=bool))
        out = []
        for doc in sorted(found):
            own = _shingle_texts(texts[doc], self.n)
            for k in sorted(found[doc]):
                hit = len(self.sets[k] & own)
                if hit >= _needed(len(self.sets[k]), self.t):
                    out.append((ids[doc], self.ids[k], len(self.sets[k]), hit, hit / len(self.sets[k])))
        return out

    def _probe(self, h, doc, found, whole):
        pos = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        if not len(pos):
            return
        lo, hi = np.searchsorted(self.keys, h[pos], "left"), np.searchsorted(self.keys, h[pos], "right")
        ok = (hi > lo) & whole(pos, doc[pos])
        for p, a, b in zip(pos[ok], lo[ok], hi[ok]):
            found.setdefault(int(doc[p]), set()).update(self.owner[a:b].tolist())


def _blocks(items: DataFrame):
    """The items in blocks of at most BLOCK_BYTES of text (one longer item is a
    block of its own), fetched partition by partition."""
    rows, size = [], 0
    for r in items.toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1] or "") + 64
        if size >= BLOCK_BYTES:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def contaminated(docs: DataFrame, items: DataFrame, shingle_words: int = SHINGLE_WORDS,
                 containment: float = CONTAINMENT, doc_id: str = "doc_id", item_id: str = "item_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document and test item it contains: (doc_id, item_id,
    n_shingles of the item, n_found, containment)."""
    d = input_tasks(documents_of(docs, doc_id, text_col))
    out = None
    for rows in _blocks(documents_of(items, item_id, text_col)):
        part = d.mapInArrow(_pass(rows, shingle_words, containment), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def _pass(rows, n, t):
    def run(batches):
        block = _Items(rows, n, t)
        for ids, texts in text_batches(batches, 2, 1):
            out = block.matches(ids, texts)
            if out:
                cols = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated documents (rows without doc_id are kept
    only if no contaminated document lacks its id), columns as in ``docs``."""
    bad = contaminated(docs, items, **options).select(F.col("doc_id").alias("_m_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("_m_bad")), "left_anti")


def clean_rows(docs: DataFrame, items: DataFrame, shingle_words: int = SHINGLE_WORDS,
               containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` whose own text holds no item, columns as in ``docs``:
    each row is decided where it was read, whatever its doc_id, so nothing is
    joined or shuffled."""
    out, text = input_tasks(docs), docs.columns.index("text")
    for rows in _blocks(documents_of(items, "item_id", "text")):
        out = out.mapInArrow(_clean(rows, shingle_words, containment, text), docs.schema)
    return out


def _clean(rows, n, t, text):
    def run(batches):
        block = _Items(rows, n, t)
        for b in text_slices(batches, text):
            keep = np.ones(b.num_rows, dtype=bool)
            keep[[x[0] for x in block.matches(range(b.num_rows), b.column(text).to_pylist())]] = False
            yield b.filter(pa.array(keep))

    return run
