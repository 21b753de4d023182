"""Best-fit packing by exact-complement hashing (operator 2).

Texts are encoded, closed with the end id, and cut into pieces only where they
are longer than the capacity (the first piece takes the odd length).  Packing
works on the counts by length, at most ``capacity`` numbers whatever the corpus
holds: for every gap, single lengths, pairs and triples that add up to exactly
the gap are looked up in indexes of length sums and consumed as often as the
counts allow; what is left is placed best-fit decreasing.  Each step empties a
length or a group of equal bins, so the plan is a few thousand patterns with
multiplicities, small enough to ship to every task.  Pieces then find their
pattern, copy and offset from their rank among the pieces of their length.

Edge cases: a null or empty text is the end id alone; rows without doc_id and
repeated rows are packed like any other; an empty table gives no rows; other
columns of the input are ignored."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents_of, input_tasks
from .tokens import default_tokenizer, encoder, slices

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; ``rank`` numbers the pieces of one length within a
    task (``task``), so a global rank needs no sort of the pieces."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        enc = encoder(tokenizer)
        for ids_col, texts in slices(batches):
            ids, n = enc.encode(texts)
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            odd = n - (count - 1) * capacity                  # the first piece's length
            length = np.where(piece == 0, odd[doc], capacity)
            start = np.where(piece == 0, 0, odd[doc] + (piece - 1) * capacity)
            at = (np.cumsum(n) - n)[doc] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            order = np.argsort(length, kind="stable")
            s = length[order]
            first = np.searchsorted(s, s, "left")
            rank = np.empty(len(s), dtype=np.int64)
            rank[order] = np.arange(len(s)) - first + seen[s]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [ids_col.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                 pa.array(crc, pa.int64()), pa.array(np.full(len(s), task, np.int32)), pa.array(rank)],
                names=[c.split()[0] for c in PIECES.split(", ")])

    return input_tasks(documents_of(docs, id_col, text_col)).mapInArrow(run, PIECES)


class _Plan:
    """Patterns (copies, [(length, pieces of it in one bin)]) for counts by length."""

    def __init__(self, counts: np.ndarray):
        self.cap = len(counts) - 1
        self.avail = counts.astype(np.int64).copy()
        self.patterns: list = []
        self._index()
        self._pack()

    def _index(self):
        """has1[s], has2[s]: lengths in stock that are s, or add up to s."""
        self.has1 = self.avail > 0
        x = self.has1.astype(float)
        f = np.fft.rfft(x, 4 * len(x))
        self.has2 = np.rint(np.fft.irfft(f * f, 4 * len(x))[:len(x)]) > 0

    def _use(self, need: dict, m: int):
        for length, k in need.items():
            self.avail[length] -= k * m
            if self.avail[length] == 0:
                self.stale = True

    def _combination(self, gap: int, held: dict):
        """Lengths in stock beside ``held`` that fill ``gap`` exactly: one, two
        or three of them, the longest first; and how often they can be used."""
        def fits(parts):
            need = dict(held)
            for p in parts:
                need[p] = need.get(p, 0) + 1
            m = min(self.avail[p] // k for p, k in need.items()) if need else 0
            return (parts, need, int(m)) if m > 0 else None

        if self.stale:
            self.stale = False
            self._index()
        if self.has1[gap] and (got := fits((gap,))):
            return got
        if self.has2[gap]:
            a = np.arange(gap // 2 + gap % 2, gap)
            for x in a[self.has1[a] & self.has1[gap - a]][::-1].tolist():
                if got := fits((x, gap - x)):
                    return got
        a = np.arange(1, max(1, gap - 1))
        for x in a[self.has1[a] & self.has2[gap - a]][::-1].tolist():
            b = np.arange(1, min(x, gap - x - 1) + 1)
            b = b[self.has1[b] & self.has1[gap - x - b]]
            for y in b[::-1].tolist():
                if got := fits((x, y, gap - x - y)):
                    return got
                if y * 2 < gap - x:
                    break
        return None

    def _pack(self):
        self.stale = True
        for length in range(self.cap, 0, -1):           # exact fills around every length, longest first
            while self.avail[length]:
                gap = self.cap - length
                if gap == 0:
                    m = int(self.avail[length])
                    self.patterns.append((m, [(length, 1)]))
                    self._use({length: 1}, m)
                    break
                got = self._combination(gap, {length: 1})
                if got is None:
                    break
                _, need, m = got
                self.patterns.append((m, list(need.items())))
                self._use(need, m)
        bins: dict[int, list] = {}                      # open bins by gap: (copies, parts)

        def put(copies, parts, gap):
            """Close what can be filled exactly, keep the rest open."""
            while copies and gap:
                got = self._combination(gap, {})
                if got is None:
                    break
                _, need, m = got
                m = min(m, copies)
                self.patterns.append((m, parts + list(need.items())))
                self._use(need, m)
                copies -= m
            if copies:
                if gap:
                    bins.setdefault(gap, []).append((copies, parts))
                else:
                    self.patterns.append((copies, parts))

        for length in range(self.cap, 0, -1):           # the rest: best-fit decreasing
            while self.avail[length]:
                left = int(self.avail[length])
                gap = min((g for g in bins if g >= length), default=None)
                if gap is None:
                    gap, copies, parts = self.cap, left, []
                else:
                    copies, parts = bins[gap].pop()
                    if not bins[gap]:
                        del bins[gap]
                each = min(gap // length, left)
                used = min(copies, left // each)
                self._use({length: each}, used)
                if parts and used < copies:
                    bins.setdefault(gap, []).append((copies - used, parts))
                put(used, parts + [(length, each)], gap - each * length)
        for groups in bins.values():
            self.patterns += groups


def plan(counts: np.ndarray) -> list:
    """Packing patterns for ``counts[length]`` pieces; ``len(counts) - 1`` is the capacity."""
    return _Plan(counts).patterns


def _intervals(patterns: list, capacity: int):
    """Ranks of every length, cut into runs that one pattern takes: sorted keys
    (length, first rank) and, per run, first sequence, pieces in a bin, offset."""
    used = np.zeros(capacity + 1, dtype=np.int64)
    rows, sequence = [], 0
    for copies, parts in patterns:
        offset = 0
        for length, each in parts:
            rows.append((length, int(used[length]), sequence, each, offset))
            used[length] += copies * each
            offset += length * each
        sequence += copies
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id,
    offset)."""
    pieces = cut(token_pieces(docs, capacity, tokenizer, id_col, text_col))
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():     # at most ``capacity`` rows
        counts[length] = n
    runs = _intervals(plan(counts), capacity)
    w = Window.partitionBy("length").orderBy("task")
    base = by_task.select("length", "task", (F.sum("n").over(w) - F.col("n")).alias("before"))

    def place(batches):
        shift = 1 << 44
        keys = runs[:, 0] * shift + runs[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            run = runs[np.searchsorted(keys, length * shift + rank, "right") - 1]
            k = rank - run[:, 1]
            cols = [b.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                cols + [pa.array(run[:, 2] + k // run[:, 3]), pa.array(run[:, 4] + k % run[:, 3] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(base, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")
