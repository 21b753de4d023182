"""Removal of repeated substrings with suffix arrays (operator 3).

Every byte is removed that lies in a ``length``-byte string of its text which
also starts earlier: in a smaller doc_id, or earlier in the same text.

1.  Windows of ``length`` bytes meet by their minimizer: the GRAM-byte gram of
    least hash inside the window.  Equal windows have the same one at the same
    place, so it is enough to compare segments (runs of windows that share a
    minimizer) with an equal gram.
2.  Segments that are equal as a whole (128-bit hash) are one class: all but
    the first are covered.  Copies inside one task's buffer are decided there,
    so a hot passage sends one row per buffer.
3.  The classes of a gram that has several are fetched as bytes, and each
    gram's segments become one string of a suffix array (gsaca: linear grouping
    over many strings at once).  Neighbours in it that share ``length`` bytes
    are equal windows, of which all but the first are covered.
4.  A gram with over GROUP classes (a very common line) is first divided by
    longer grams around it, down to single windows, so no group is unbounded.

Edge cases: a null text is empty; texts shorter than ``length`` lose nothing;
repeated rows (same id and text) are one document, reported as often as they
come; rows without doc_id come before all others, in the order of a hash of
their text; different texts must have different ids; an empty table gives no
rows; other columns of the input are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents_of, input_tasks
from .gsaca import suffix_arrays
from .textvec import PolyHash, join_texts, mix64, text_batches

LENGTH = 100
GRAM = 32
GROUP = 32              # classes of one gram in one suffix array
STRIDE = 16             # window offsets that a divided gram keeps together
BUFFER = 1 << 21        # bytes hashed at a time
_POS = 24               # bits of a place in a buffer


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_m_doc, _m_id, _m_text): _m_doc is the id, or for a row without one a
    number below all ids."""
    d = documents_of(docs, id_col, text_col)
    low = F.lit(-(2**62)) - F.shiftrightunsigned(F.xxhash64(F.coalesce("_m_text", F.lit(""))), 2)
    return d.select(F.coalesce("_m_id", low).alias("_m_doc"), "_m_id", "_m_text")


def _chunks(raw: bytes, length: int):
    """(offset, bytes) pieces whose windows are those of ``raw``, each once."""
    for p in range(0, max(1, len(raw) - length + 1), BUFFER):
        yield p, raw[p:p + BUFFER + length - 1]


def _segments(data: bytes, at: np.ndarray, length: int, poly):
    """Runs of windows that share a minimizer, over the texts that start at
    ``at`` (a separator after each): (gram hash, segment hash, first window,
    last window, gram's place, text)."""
    a = np.frombuffer(data, np.uint8)
    size = np.diff(at) - 1
    long = size >= length
    if not long.any():
        return None
    s1, s2 = poly[0].prefix(a), poly[1].prefix(a)
    n = len(a) - GRAM + 1
    h = mix64((s1[GRAM:] - s1[:-GRAM]) * poly[0].ipw[:n])
    m = ((h >> np.uint64(_POS)) << np.uint64(_POS)) | np.arange(n, dtype=np.uint64)
    w, width = length - GRAM + 1, 1
    while width * 2 <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < w:
        m = np.minimum(m[:-(w - width)], m[w - width:])
    gram = (m & np.uint64((1 << _POS) - 1)).astype(np.int64)
    start = np.repeat(at[:-1][long] - (np.cumsum(size[long] - length + 1) - (size[long] - length + 1)), size[long] - length + 1)
    start = start + np.arange(len(start))
    q = gram[start]
    new = np.ones(len(q), dtype=bool)
    new[1:] = (q[1:] != q[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi = start[first], start[np.append(first[1:], len(q)) - 1]
    sel = q[first]
    return h[sel], mix64(poly[1].spans(s2, lo, hi + length)), lo, hi, sel, np.searchsorted(at, lo, "right") - 1


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """(key, seg, doc, pack, done): a segment with its place packed as first
    window, windows - 1 and the gram's offset; or with ``done`` a covered span
    from ``pack`` to ``seg``."""
    def run(batches):
        poly = (PolyHash(31), PolyHash(32))
        for doc, texts in text_batches(batches, 2, 1, BUFFER):
            pieces, base, of = [], [], []
            for d, t in zip(doc, texts):
                for p, piece in _chunks((t or "").encode("utf-8", "surrogatepass"), length):
                    pieces.append(piece)
                    base.append(p)
                    of.append(d)
            base, of = np.array(base, np.int64), np.array(of, np.int64)
            groups, size = [0], 0
            for i, piece in enumerate(pieces):          # at most two buffers' worth of bytes at a time
                size += len(piece)
                if size >= BUFFER or i == len(pieces) - 1:
                    groups.append(i + 1)
                    size = 0
            for i, j in zip(groups, groups[1:]):
                data, at = join_texts(pieces[i:j])
                got = _segments(data, at, length, poly)
                if got is not None:
                    yield _local(*got, at, base[i:j], of[i:j], length)

    return (docs.select("_m_doc", "_m_text").mapInArrow(run, "key long, seg long, doc long, pack long, done boolean"))


def _not_repeated(*cols) -> np.ndarray:
    """Rows that differ from the row before: a repeated row is one document."""
    out = np.ones(len(cols[0]), dtype=bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return out


def _local(key, seg, lo, hi, sel, text, at, base, of, length):
    doc = of[text]
    place = lo - at[text] + base[text]
    pack = (place << 14) | ((hi - lo) << 7) | (sel - lo)
    order = np.lexsort((pack, doc, seg, key))
    order = order[_not_repeated(key[order], seg[order], doc[order], pack[order])]
    k, s = key[order], seg[order]
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (k[1:] == k[:-1]) & (s[1:] == s[:-1])
    keep = order[~again]
    gone = np.sort(order[again])            # in text order: merge what touches
    cols = [key[keep].view(np.int64), seg[keep].view(np.int64), doc[keep], pack[keep], np.zeros(len(keep), bool)]
    if len(gone):
        a, b, d = place[gone], place[gone] + (hi - lo)[gone] + length, doc[gone]
        new = np.ones(len(gone), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (a[1:] > b[:-1]) | (text[gone][1:] != text[gone][:-1])
        first = np.flatnonzero(new)
        end = np.maximum.reduceat(b, first)
        more = [mix64(d[first].astype(np.uint64)).view(np.int64), end, d[first], a[first], np.ones(len(first), bool)]
        cols = [np.concatenate(x) for x in zip(cols, more)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "seg", "doc", "pack", "done"])


def _classes(anchors: DataFrame, length: int) -> DataFrame:
    """(doc, lo, hi, key, rel): covered spans (key null), and the segments that
    stand for the classes of a gram with several."""
    names = ["doc", "lo", "hi", "key", "rel"]

    def rows(doc, lo, hi, key, rel):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo), pa.array(hi), key, pa.array(rel.astype(np.int32))],
                                          names=names)

    def wanted(key, doc, pack):
        lo = pack >> 14
        return rows(doc, lo, lo + ((pack >> 7) & 127) + length, pa.array(key), pack & 127)

    def covered(doc, lo, hi):
        return rows(doc, lo, hi, pa.nulls(len(doc), pa.int64()), np.zeros(len(doc)))

    def run(batches):
        last = None         # (key, seg, row that stands for the class, whether the key has others)
        before = None       # the row before this batch
        for b in batches:
            key, seg, doc, pack = (b.column(i).to_numpy() for i in range(4))
            done = b.column(4).to_numpy(zero_copy_only=False)
            if done.any():
                yield covered(doc[done], pack[done], seg[done])
                key, seg, doc, pack = (x[~done] for x in (key, seg, doc, pack))
            if not len(key):
                continue
            fresh = _not_repeated(key, seg, doc, pack)
            fresh[0] = (key[0], seg[0], doc[0], pack[0]) != before
            before = (key[-1], seg[-1], doc[-1], pack[-1])
            key, seg, doc, pack = (x[fresh] for x in (key, seg, doc, pack))
            if not len(key):
                continue
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (seg[1:] != seg[:-1])
            goes_on = last is not None and last[0] == key[0]
            if goes_on and last[1] == seg[0]:
                new[0] = False
            old = ~new
            if old.any():
                lo = pack[old] >> 14
                yield covered(doc[old], lo, lo + ((pack[old] >> 7) & 127) + length)
            at = np.flatnonzero(new)
            if not len(at):
                continue
            k = key[at]
            head = np.ones(len(k), dtype=bool)
            head[1:] = k[1:] != k[:-1]
            g = np.cumsum(head) - 1
            many = np.bincount(g) > 1
            if goes_on and k[0] == last[0]:
                many[0] = True
                if not last[3]:
                    yield wanted(*(np.array([x], np.int64) for x in (last[0], *last[2])))
            ask = many[g]
            if ask.any():
                yield wanted(k[ask], doc[at][ask], pack[at][ask])
            i = at[-1]
            last = (key[i], seg[i], (doc[i], pack[i]), bool(many[-1]))

    parts = anchors.repartition("key").sortWithinPartitions("key", "seg", "doc", "pack")
    return parts.mapInArrow(run, "doc long, lo long, hi long, key long, rel int")


def _bytes(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, sub, doc, lo, rel, bytes) of the asked segments."""
    per = asked.groupBy("doc").agg(F.collect_list(F.struct("key", "lo", "hi", "rel")).alias("asks"))
    text = (docs.select("_m_doc", F.col("_m_text").cast("binary").alias("t"))
                .join(per, docs["_m_doc"] == per["doc"]))
    got = F.transform("asks", lambda r: F.struct(
        r["key"].alias("key"), r["lo"].alias("lo"), r["rel"].alias("rel"),
        F.substring(F.col("t"), (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")).alias("bytes")))
    return (text.select("doc", F.explode(got).alias("x"))
                .select("x.key", F.lit(0).cast("long").alias("sub"), "doc", "x.lo", "x.rel", "x.bytes").distinct())


def _divided(segments: DataFrame, length: int, stride: int) -> DataFrame:
    """Segments cut into the windows whose distance to the gram lies in one
    block of ``stride``; the group goes by the longer gram that they share."""
    n = F.octet_length("bytes") - (length - 1)
    blocks = F.sequence(F.floor(F.greatest(F.col("rel") - n + 1, F.lit(0)) / stride), F.floor(F.col("rel") / stride))
    x = segments.withColumn("n", n).withColumn("j", F.explode(blocks))
    first = F.greatest(F.lit(0), F.col("rel") - F.col("j") * stride - (stride - 1))
    end = F.least(F.col("n") - 1, F.col("rel") - F.col("j") * stride)        # last window of the block
    x = x.withColumn("a", first.cast("int")).withColumn("z", end.cast("int")).filter("a <= z")
    shared = F.substring(F.col("bytes"), (F.col("rel") - F.col("j") * stride + 1).cast("int"), F.lit(length - stride + 1))
    return x.select("key", F.xxhash64("sub", "j", shared).alias("sub"), "doc", (F.col("lo") + F.col("a")).alias("lo"),
                    (F.col("rel") - F.col("a")).cast("int").alias("rel"),
                    F.substring(F.col("bytes"), F.col("a") + 1, F.col("z") - F.col("a") + length).alias("bytes"))


def _small_groups(segments: DataFrame, length: int):
    """(segments in groups of at most GROUP classes, covered spans found on the
    way): large groups are divided by longer grams, equal segments merged."""
    spans = None
    for stride in (STRIDE, 1):
        size = segments.groupBy("key", "sub").agg(F.count(F.lit(1)).alias("classes"))
        hot = size.filter(F.col("classes") > GROUP)
        small = segments.join(hot, ["key", "sub"], "left_anti")
        part = cut(_divided(segments.join(hot.select("key", "sub"), ["key", "sub"]), length, stride))
        place = F.struct("doc", "lo")
        kept = cut(part.groupBy("key", "sub", "bytes").agg(F.min(place).alias("p"), F.min(F.struct("doc", "lo", "rel")).alias("r"),
                                                           F.count(F.lit(1)).alias("copies")))
        again = (part.join(kept.filter("copies > 1").select("key", "sub", "bytes", "p"), ["key", "sub", "bytes"])
                     .filter(place != F.col("p")).select("doc", "lo", (F.col("lo") + F.octet_length("bytes")).alias("hi")))
        spans = again if spans is None else spans.unionByName(again)
        segments = small.unionByName(kept.select("key", "sub", F.col("r.doc").alias("doc"), F.col("r.lo").alias("lo"),
                                                 F.col("r.rel").alias("rel"), "bytes"))
        segments = cut(segments)
    # after the last division a group is one window; its copies are merged, nothing is left to compare
    several = segments.groupBy("key", "sub").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    return segments.join(several.select("key", "sub"), ["key", "sub"], "left_semi"), spans


def equal_windows(strings: list, length: int):
    """For strings that are lists of (doc, lo, bytes): (doc, lo, hi) arrays of
    the windows of ``length`` bytes that occur earlier in the same string, as
    runs.  Strings are sorted together, those of like size at a time."""
    order = sorted(range(len(strings)), key=lambda i: sum(len(x[2]) for x in strings[i]))
    out, held, size = [], [], 0
    for i in order:
        held.append(strings[i])
        size += sum(len(x[2]) + 1 for x in strings[i])
        if size >= 1 << 20:
            out.append(_sorted_windows(held, length))
            held, size = [], 0
    if held:
        out.append(_sorted_windows(held, length))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _sorted_windows(strings: list, length: int):
    flat = [x for s in strings for x in s]
    sizes = np.array([len(x[2]) for x in flat])
    doc, lo = (np.array([x[i] for x in flat], dtype=np.int64) for i in (0, 1))
    # letters 1..256, 0 after every segment
    end = np.cumsum(sizes + 1)
    text = np.zeros(int(end[-1]) + length, dtype=np.uint16)
    letter = np.ones(len(text), dtype=bool)
    letter[end - 1] = False
    letter[end[-1]:] = False
    text[letter] = np.frombuffer(b"".join(x[2] for x in flat), np.uint8).astype(np.uint16) + 1
    per = np.cumsum([len(s) for s in strings])
    lane = np.concatenate(([0], end[per - 1]))
    sa = suffix_arrays(text[:end[-1]], lane)
    seg = np.repeat(np.arange(len(flat)), sizes + 1)
    start = end - sizes - 1
    window = (np.arange(end[-1]) + length) < end[seg]           # a whole window starts here
    x, y = sa[:-1], sa[1:]
    lane_of = np.repeat(np.arange(len(lane) - 1), np.diff(lane))
    at = np.flatnonzero(window[x] & window[y] & (lane_of[x] == lane_of[y]))
    for step in range(0, length, 4):                             # drop pairs at the first difference
        if not len(at):
            break
        a, b = sa[at], sa[at + 1]
        same = np.ones(len(at), dtype=bool)
        for c in range(step, min(step + 4, length)):
            same &= text[a + c] == text[b + c]
        at = at[same]
    if not len(at):
        return [np.zeros(0, np.int64)] * 3
    # runs of neighbours: one class of equal windows each
    new = np.ones(len(at), dtype=bool)
    new[1:] = at[1:] != at[:-1] + 1
    cls = np.cumsum(new) - 1
    members = np.concatenate((sa[at[new]], sa[at + 1]))
    cls = np.concatenate((np.arange(int(cls[-1]) + 1), cls))
    d, p = doc[seg[members]], lo[seg[members]] + members - start[seg[members]]
    order = np.lexsort((p, d, cls))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = cls[order][1:] == cls[order][:-1]
    pick = order[again]
    d, p = d[pick], p[pick]
    order = np.lexsort((p, d))
    d, p = d[order], p[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1)
    first = np.flatnonzero(new)
    return [d[first], p[first], p[np.append(first[1:], len(p)) - 1] + length]


def _suffix_spans(segments: DataFrame, length: int) -> DataFrame:
    """(doc, lo, hi): covered spans found by the suffix arrays of the groups."""
    def run(batches):
        held, size, last = [], 0, None
        for b in batches:
            for key, sub, doc, lo, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                if (key, sub) != last:
                    if size >= 1 << 23:
                        yield _spans(equal_windows(held, length))
                        held, size = [], 0
                    held.append([])
                    last = (key, sub)
                held[-1].append((doc, lo, data))
                size += len(data)
        if held:
            yield _spans(equal_windows(held, length))

    parts = (segments.select("key", "sub", "doc", "lo", "bytes").repartition("key", "sub")
                     .sortWithinPartitions("key", "sub", "doc", "lo"))
    return parts.mapInArrow(run, "doc long, lo long, hi long")


def _spans(cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc", "lo", "hi"])


def covered_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, lo, hi): spans (they may overlap) whose union is what is to be
    removed; ``doc`` as in ``_identified``."""
    if not GRAM < length <= GRAM + 127:
        raise ValueError("length must be over GRAM and at most GRAM + 127")
    d = input_tasks(_identified(docs, id_col, text_col))
    found = cut(_classes(_anchors(d, length), length))
    segments = cut(_bytes(d, found.filter("key IS NOT NULL")))
    segments, more = _small_groups(segments, length)
    return (found.filter("key IS NULL").select("doc", "lo", "hi").unionByName(more)
                 .unionByName(_suffix_spans(segments, length)))


def _apply(raw: bytes, spans) -> tuple[bytes, int, int]:
    """(bytes left, removed, maximal runs removed)."""
    out, at, removed, runs = [], 0, 0, 0
    last = -1
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if lo > last:
            runs += 1
        if hi > last:
            out.append(raw[at:max(at, lo)])
            removed += hi - max(lo, last if last >= 0 else lo)
            at = last = hi
    out.append(raw[at:])
    return b"".join(out), removed, runs


def _with_spans(docs, length, id_col, text_col):
    spans = cut(covered_spans(docs, length, id_col, text_col))
    per = spans.groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    d = _identified(docs, id_col, text_col)
    return d.join(per, d["_m_doc"] == per["doc"], "left").select("_m_id", "_m_text", "spans")


def dedup_substrings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                     with_bytes: bool = False) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_removed, n_spans, kept_sha256
    and, if asked for, ``kept`` binary: the remaining bytes)."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary" if with_bytes else ""

    def run(batches):
        for b in batches:
            rows = []
            for doc, text, spans in zip(*(b.column(i).to_pylist() for i in range(3))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept, removed, runs = _apply(raw, spans)
                rows.append((doc, len(raw), removed, runs, hashlib.sha256(kept).hexdigest()) + ((kept,) if with_bytes else ()))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 names=[c.split()[0] for c in schema.split(", ")])

    return _with_spans(docs, length, id_col, text_col).mapInArrow(run, schema)
