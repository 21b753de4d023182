"""Ranked lexical search by presence-mask grouping (operator 12).

A term is a maximal run of ASCII letters and digits and of all characters
beyond ASCII; only A-Z are lower-cased.  An item's score for a document sums,
over the item's distinct terms, weight times saturated frequency, in whole
numbers (see ``contribution``).

For every item the documents of a block are grouped by their presence mask: the
set of the item's terms that they hold, made from one bitmap over the
documents for each term, turned from term rows into document rows.  A mask's
maximum score is the sum of its terms' largest contributions in the block.
Masks are scored by falling maximum until the next maximum is below the tenth
best score found (an equal one is still scored, for ties by doc_id); what a
task has found so far counts for its next blocks too.  Nothing is cut: a mask
that is left out cannot hold one of the ten best.

The items are the stated query set.  They are taken in blocks of at most
BLOCK_BYTES of terms, so neither the driver nor a task ever holds more of them;
each block makes one pass over the texts, which writes an index of the
documents (length, and the frequencies of the block's terms).  The ten best of
an item come from at most ten rows of each task.

Edge cases: a null, empty or term-less text holds nothing and does not count as
a document; rows of one item_id are one item with the terms of all of them,
rows without item_id ask for nothing, items without terms have no rows;
repeated documents are ranked each, rows without doc_id after others of the
same score; empty tables give no rows; other columns are ignored."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents_of, input_tasks
from .textvec import text_batches

TOP = 10
BLOCK_BYTES = 8 << 20    # terms of one block of items
DOCS = 8192              # documents whose masks are grouped at a time
EVALUATE = 64            # documents scored at a time, at least

# Bytes of terms stay (A-Z as a-z), all others part them.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    """The weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n, n_docs: int, n_terms: int):
    return 100 - 90 + (90 * n * n_docs) // n_terms


def contribution(tf, m):
    """Saturated frequency, in whole numbers: tf / (tf + 0.008 m) times 10^6."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def item_blocks(items: DataFrame, id_col: str, text_col: str, limit: int):
    """Lists of (item_id, sorted terms), each of at most ``limit`` bytes of
    terms (one larger item is a list of its own)."""
    rows = (items.select(items[id_col].cast("long").alias("item"), items[text_col].cast("string").alias("text"))
            .filter("item IS NOT NULL AND text IS NOT NULL").dropDuplicates())
    block, size, last, own = [], 0, None, set()
    for item, text in rows.orderBy("item", "text").toLocalIterator():
        if item != last and own:
            block.append((last, sorted(own)))
            size += sum(map(len, own))
            own = set()
            if size >= limit:
                yield block
                block, size = [], 0
        last = item
        own.update(terms_of(text))
    if own:
        block.append((last, sorted(own)))
    if block:
        yield block


def index_documents(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: its number of
    terms, and numbers and frequencies of those in ``vocabulary``."""
    number = {t: k for k, t in enumerate(vocabulary)}

    def index(batches):
        known = number.keys()
        for ids, texts in text_batches(batches, 2, 1):
            out: list[list] = [[], [], [], []]
            for i, text in zip(ids, texts):
                words = terms_of(text)
                if words:
                    tf = Counter(words)
                    held = sorted((number[t], tf[t]) for t in tf.keys() & known)
                    for column, value in zip(out, (i, len(words), [k for k, _ in held], [c for _, c in held])):
                        column.append(value)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                   pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.int32()))],
                                  names=["doc_id", "n", "terms", "tfs"])

    return input_tasks(documents_of(docs, id_col, text_col)).mapInArrow(index, "doc_id long, n long, terms array<int>, tfs array<int>")


class _Postings:
    """The documents of one block by term: postings sorted by term, with the
    score that each adds, and a packed bitmap over the documents for each term."""

    def __init__(self, terms: np.ndarray, tfs: np.ndarray, counts: np.ndarray, m: np.ndarray, weights: np.ndarray):
        doc = np.repeat(np.arange(len(counts)), counts)
        order = np.argsort(terms, kind="stable")
        self.size, self.doc = len(counts), doc[order]
        self.adds = (weights[terms] * contribution(tfs, m[doc]))[order]
        present, start = np.unique(terms[order], return_index=True)
        self.at = dict(zip(present.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(terms)])))
        self.most = dict(zip(present.tolist(), np.maximum.reduceat(self.adds, start).tolist() if len(terms) else []))
        self.bitmaps: dict[int, np.ndarray] = {}

    def bitmap(self, term: int) -> np.ndarray:
        if term not in self.bitmaps:
            a, b = self.at[term]
            bits = np.zeros(self.size, dtype=np.uint8)
            bits[self.doc[a:b]] = 1
            self.bitmaps[term] = np.packbits(bits)
        return self.bitmaps[term]

    def masks(self, terms: list[int]):
        """(bits: masks x terms, documents ordered by mask, where each mask's
        documents start), for the documents that hold any of ``terms``."""
        rows = np.unpackbits(np.stack([self.bitmap(t) for t in terms]), axis=1, count=self.size)
        docs = np.flatnonzero(rows.any(axis=0))
        key = np.packbits(rows[:, docs], axis=0, bitorder="little")
        key = np.concatenate([key, np.zeros((-len(key) % 8, len(docs)), dtype=np.uint8)])
        key = np.ascontiguousarray(key.T).view("<u8")
        order = np.lexsort(key.T)
        key = key[order]
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])[:len(key)])
        bits = np.unpackbits(np.ascontiguousarray(key[start]).view(np.uint8), axis=1, bitorder="little")[:, :len(terms)]
        return bits, docs[order], start

    def scores(self, terms: list[int], docs: np.ndarray):
        """Score and number of terms of the documents ``docs``."""
        total, held = np.zeros(len(docs), dtype=np.int64), np.zeros(len(docs), dtype=np.int64)
        for t in terms:
            a, b = self.at[t]
            p = a + np.searchsorted(self.doc[a:b], docs)
            hit = p < b
            hit[hit] = self.doc[p[hit]] == docs[hit]
            total[hit] += self.adds[p[hit]]
            held[hit] += 1
        return total, held


def best_of_block(post: _Postings, terms: list[int], ids: np.ndarray, found: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` best rows (score, doc_id, has no id, terms held) of ``found``
    and of the block's documents, scored mask by mask."""
    here = [t for t in terms if t in post.at]
    if not here:
        return found
    bits, docs, start = post.masks(here)
    most = bits.astype(np.int64) @ np.array([post.most[t] for t in here], dtype=np.int64)
    end = np.append(start[1:], len(docs))
    order = np.argsort(-most, kind="stable")
    k = 0
    while k < len(order) and most[order[k]] > 0 and (len(found) < top or most[order[k]] >= found[-1, 0]):
        some = []
        while k < len(order) and most[order[k]] > 0 and sum(map(len, some)) < EVALUATE:
            some.append(docs[start[order[k]]:end[order[k]]])
            k += 1
        some = np.concatenate(some)
        score, held = post.scores(here, some)
        new = np.column_stack([score, ids[some], held])[score > 0]
        found = np.concatenate([found, new])
        found = found[np.lexsort((found[:, 1], -found[:, 0]))][:top]
    return found


_NO_ID = np.iinfo(np.int64).max    # sorts after every doc_id


def rank_block(index: DataFrame, block: list, vocabulary: list[bytes], top: int) -> DataFrame:
    """(item_id, rank, doc_id, score, n_matched) for one block of items."""
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = index.select(F.explode("terms").alias("t")).groupBy("t").count().collect()    # at most the block's terms
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for t, n in df:
        weights[t] = weight(n_docs, n)
    number = {t: k for k, t in enumerate(vocabulary)}
    asked = [(item, [number[t] for t in terms]) for item, terms in block]

    def rank(batches):
        found = {item: np.zeros((0, 3), dtype=np.int64) for item, _ in asked}

        def take(parts):
            b = pa.Table.from_batches(parts).combine_chunks()
            ids = b["doc_id"].fill_null(_NO_ID).to_numpy()
            lists = b["terms"].combine_chunks()
            flat = b["tfs"].combine_chunks()
            post = _Postings(lists.flatten().to_numpy().astype(np.int64), flat.flatten().to_numpy().astype(np.int64),
                             lists.value_lengths().to_numpy(), length_norm(b["n"].to_numpy(), n_docs, n_terms), weights)
            for item, terms in asked:
                found[item] = best_of_block(post, terms, ids, found[item], top)

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= DOCS:
                take(held)
                held, rows = [], 0
        if rows:
            take(held)
        out = [(item, *r) for item, best in found.items() for r in best.tolist()]
        cols = list(zip(*out)) if out else [[], [], [], []]
        yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array([None if i == _NO_ID else i for i in cols[2]], pa.int64()),
                               pa.array(cols[1], pa.int64()), pa.array(cols[3], pa.int64())],
                              names=["item_id", "doc_id", "score", "n_matched"])

    best = index.mapInArrow(rank, "item_id long, doc_id long, score long, n_matched long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score", "n_matched"))


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score, n_matched): the ``top`` documents with the
    highest scores above 0 for every item; ``n_matched`` of its terms are in
    the document."""
    spark = docs.sparkSession
    out = None
    for block in item_blocks(items, item_col, item_text, block_bytes):
        vocabulary = sorted(set().union(*(terms for _, terms in block)))
        index = cut(index_documents(docs, vocabulary, id_col, text_col))
        if index.isEmpty():
            break
        part = cut(rank_block(index, block, vocabulary, top))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long, n_matched long")
    return out
