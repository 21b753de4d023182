"""Matching texts against word lists of any size (J3, L2, ST7): an automaton.

The words become one Aho-Corasick automaton over UTF-8 bytes, kept as arrays:
the complete transition table (bytes that no word holds share one column) and,
for every state, the word that ends there and the next shorter word that ends
there too.  A text costs one table look-up a byte, however many words there
are.  Tasks step many stretches of their texts at once; stretches overlap by
the longest word, so no match is lost at a cut.

The automaton travels to the tasks, so its size is checked: words are read in
sorted order and dealt to groups of at most MOST_STATES states (words with the
same first letters stay together).  A list of one group is one automaton.

A longer list would be a pass over all bytes for every group, so it becomes a
table of hashes instead: a match lies within a run of letters that occur in
words, runs repeat between texts, and every stretch of a distinct run whose
length is that of a word is looked up and compared.  A table holds MOST_WORDS
words; only beyond that the list is taken in parts, a pass each over the texts,
which are computed and written once then.

Matching is by substring and case-sensitive, as in the batch rules.  Blank
words match nothing; a word listed twice has its first place; null texts hold
no word."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import REPEATS, cut

MOST_STATES = 1 << 17    # of one automaton: at most 128 MB of transitions, some 30 MB for one alphabet
STRETCH = 256            # bytes that are stepped through at a time, at least
SLICE = 1 << 21          # bytes of text that a task steps through together
MOST_WORDS = 1 << 21     # of one table: some 40 bytes each
RUNS_SLICE = 1 << 22     # bytes of text whose runs are looked up together
PAIRS = 1 << 21          # pairs of text and word that are sorted together
_GAP = 0xFF              # never part of UTF-8: parts one text from the next


def _once(x: np.ndarray) -> np.ndarray:
    """The distinct values in order (``np.unique`` hashes, which takes far longer)."""
    x = np.sort(x)
    return x[np.diff(x, prepend=x[:1] - 1) != 0]


class Automaton:
    """The automaton of a list of distinct byte strings."""

    def __init__(self, words: list[bytes]):
        self.longest = max(map(len, words))
        used = sorted({b for w in words for b in w})
        self.column = np.zeros(256, dtype=np.int32)
        self.column[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for k, w in enumerate(words):
            at = 0
            for b in self.column[np.frombuffer(w, dtype=np.uint8)].tolist():
                to = children[at].get(b)
                if to is None:
                    to = children[at][b] = len(children)
                    children.append({})
                    ends.append(-1)
                at = to
            ends[at] = k
        n = len(children)
        self.next = np.zeros((n, width), dtype=np.int32)    # column 0: a byte of no word, back to the root
        self.word = np.array(ends, dtype=np.int32)          # the word that ends at a state
        self.also = np.zeros(n, dtype=np.int32)             # the longest shorter match at it (0: none)
        fail = [0] * n
        level = []
        for b, to in children[0].items():
            self.next[0, b] = to
            level.append(to)
        while level:    # level by level: a state's failure state lies on an earlier one
            deeper = []
            for s in level:
                f = fail[s]
                self.also[s] = f if ends[f] >= 0 else self.also[f]
                self.next[s] = self.next[f]
                for b, to in children[s].items():
                    fail[to] = int(self.next[f, b])
                    self.next[s, b] = to
                    deeper.append(to)
            level = deeper
        self.first = np.where(self.word >= 0, np.arange(n), self.also).astype(np.int32)   # the longest match at a state
        self.next = self.next.ravel() * width       # row offsets
        self.width = width

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, state) of every byte of ``data`` where a word ends."""
        stretch = max(STRETCH, 4 * self.longest)
        start = np.arange(0, len(data), stretch)
        column = self.column[data]
        column = np.concatenate([np.zeros(self.longest - 1, dtype=np.int32), column, np.zeros(stretch, dtype=np.int32)])
        state = np.zeros(len(start), dtype=np.int32)
        ends = np.zeros(len(self.first) * self.width, dtype=bool)
        ends[::self.width] = self.first > 0
        where, what = [], []
        for k in range(stretch + self.longest - 1):
            state = self.next[state + column[start + k]]
            hit = np.flatnonzero(ends[state])
            if len(hit):
                where.append(start[hit] + (k - self.longest + 1))
                what.append(state[hit] // self.width)
        if not where:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        return np.concatenate(where), np.concatenate(what)

    def found(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, word), each once: the words that the texts hold."""
        data = np.frombuffer(b"".join(t + b"\xff" for t in texts), dtype=np.uint8)
        where, state = self.hits(data)
        end = np.cumsum([len(t) + 1 for t in texts])
        text = np.searchsorted(end, where, "right")
        key = _once(text * np.int64(len(self.first)) + self.first[state])
        text, state = key // len(self.first), key % len(self.first)
        out = []
        while len(state):
            out.append(text * np.int64(len(self.first)) + self.word[state])
            text, state = text[self.also[state] > 0], self.also[state][self.also[state] > 0]
        key = _once(np.concatenate(out)) if out else np.zeros(0, dtype=np.int64)
        return key // len(self.first), key % len(self.first)


def _runs(data: np.ndarray, used: np.ndarray, least: int):
    """(starts, lengths) of the longest stretches of ``used`` bytes, from ``least`` on."""
    mask = np.concatenate([[False], used[data], [False]])
    edge = np.flatnonzero(mask[1:] != mask[:-1])
    start, n = edge[::2], edge[1::2] - edge[::2]
    return start[n >= least], n[n >= least]


def _spans(start, n):
    """The numbers start, start + 1 ... of every span, ``n`` long, one after another."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class WordTable:
    """A list of distinct byte strings by length and hash.  Hashes only lead to
    words, bytes decide: words of one hash are all compared."""

    MIX = np.uint64(0x9E3779B97F4A7C15)
    BASE = 0xD1342543DE82EF95       # odd, so it has an inverse

    def __init__(self, words: pa.Array):
        size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(b"".join(words.to_pylist()), dtype=np.uint8)
        self.codes = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.used = np.zeros(256, dtype=bool)
        self.used[data] = True
        start = np.cumsum(size) - size
        self.by_length = []         # (length, shift, filter, hashes, words, their bytes)
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            letters = data[start[own][:, None] + np.arange(n)]
            powers = self._powers(n)[0]
            h = (self.codes[letters] * powers[:n]).sum(axis=1, dtype=np.uint64)
            order = np.argsort(h)
            bits = max(4, int(8 * len(own)).bit_length())
            able = np.zeros(1 << bits, dtype=bool)
            able[(h * self.MIX) >> np.uint64(64 - bits)] = True
            self.by_length.append((n, np.uint64(64 - bits), able, h[order], own[order].astype(np.int32), letters[order]))
        self.size = len(words)

    @classmethod
    def _powers(cls, n: int):
        """The powers of the base up to ``n``, and of its inverse."""
        out = []
        for b in (cls.BASE, pow(cls.BASE, -1, 1 << 64)):
            x = np.full(n + 1, b, dtype=np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        return out

    def in_runs(self, data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(run, word), each once and in order, of the runs of ``data`` that end at ``end``."""
        up, down = self._powers(len(data))
        part = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.codes[data] * up[:-1], dtype=np.uint64)])
        size = np.diff(end, prepend=0)
        room = np.repeat(end, size) - np.arange(len(data))      # bytes from a place to the end of its run
        at, out = np.arange(len(data)), []
        for n, shift, able, hashes, word, letters in self.by_length:
            at = at[room[at] >= n]
            if not len(at):
                break
            h = (part[at + n] - part[at]) * down[at]
            some = np.flatnonzero(able[(h * self.MIX) >> shift])
            h, place = h[some], at[some]
            low = np.searchsorted(hashes, h)
            hit = np.flatnonzero((low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == h))
            low, place = low[hit], place[hit]
            many = np.searchsorted(hashes, h[hit], "right") - low
            k, place = _spans(low, many), np.repeat(place, many)
            for y in range(0, len(k), PAIRS):
                same = (np.lib.stride_tricks.sliding_window_view(data, n)[place[y:y + PAIRS]] == letters[k[y:y + PAIRS]]).all(axis=1)
                out.append(np.searchsorted(end, place[y:y + PAIRS][same], "right") * np.int64(self.size) + word[k[y:y + PAIRS][same]])
        key = _once(np.concatenate(out)) if out else np.zeros(0, dtype=np.int64)
        return key // self.size, key % self.size

    def found(self, texts: list[bytes], first: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(text, word), each once: the words that the texts hold, or the first one of each."""
        none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if not self.by_length:
            return none
        data = np.frombuffer(b"".join(t + b"\xff" for t in texts), dtype=np.uint8)
        start, n = _runs(data, self.used, self.by_length[0][0])
        if not len(start):
            return none
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
        letters = data[_spans(start, n)]
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
        held = coded.dictionary
        size = pc.binary_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
        run, word = self.in_runs(np.frombuffer(b"".join(held.to_pylist()), dtype=np.uint8), np.cumsum(size))
        begin = np.searchsorted(run, np.arange(len(held) + 1))
        pair = _once(text * np.int64(len(held)) + coded.indices.to_numpy())
        text, own = pair // len(held), pair % len(held)
        some = begin[own + 1] > begin[own]
        text, own = text[some], own[some]
        if not len(text):
            return none
        if first:       # words of a run are in list order
            at = np.flatnonzero(np.diff(text, prepend=-1))
            return text[at], np.minimum.reduceat(word[begin[own]], at)
        many, out, y = begin[own + 1] - begin[own], [], 0
        work = np.cumsum(many)
        while y < len(text):
            z = max(y + 1, int(np.searchsorted(work, (work[y - 1] if y else 0) + PAIRS, "right")))
            z = int(np.searchsorted(text, text[z - 1], "right"))        # whole texts
            out.append(_once(np.repeat(text[y:z], many[y:z]) * np.int64(self.size) + word[_spans(begin[own[y:z]], many[y:z])]))
            y = z
        key = np.concatenate(out)
        return key // self.size, key % self.size


def word_groups(words: DataFrame, most_states: int = MOST_STATES) -> Iterator[list[tuple[int, str]]]:
    """The list (pos, word), first places only, in groups of words that are
    neighbours in sorted order and make at most ``most_states`` states (one
    longer word is a group of its own)."""
    rows = _listed(words).orderBy("word")
    group, states, last = [], 1, b""
    for pos, word in rows.toLocalIterator():
        b = word.encode("utf-8", "surrogatepass")
        same = next((i for i, (x, y) in enumerate(zip(last, b)) if x != y), min(len(last), len(b)))
        if group and states + len(b) - same > most_states:
            yield group
            group, states, same = [], 1, 0
        group.append((pos, word))
        states += len(b) - same
        last = b
    if group:
        yield group


def _listed(words: DataFrame) -> DataFrame:
    """(pos, word) of the list, first places only."""
    return (words.filter("word IS NOT NULL AND trim(word) <> ''").groupBy("word").agg(F.min("pos").cast("long").alias("pos"))
            .select("pos", "word"))


def _slices(batches, text: int, most: int):
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False) + 1)
        low = 0
        while low < b.num_rows:
            high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + most, "right")))
            yield b.slice(low, high - low)
            low = high


def group_matches(texts: DataFrame, group: list[tuple[int, str]], text_col: str, first: bool) -> DataFrame:
    """One row per text and word of ``group`` that it holds (``first``: only the
    word with the smallest (pos, word)): the other columns of ``texts``, pos, word."""
    group = sorted(group)
    automaton = Automaton([w.encode("utf-8", "surrogatepass") for _, w in group])

    def found(rows):
        row, word = automaton.found(rows)
        one = np.flatnonzero(np.diff(row, prepend=-1)) if first and len(row) else slice(None)    # words are numbered in list order
        return row[one], word[one]

    return _matched(texts, text_col, found, pa.array([p for p, _ in group], pa.int64()), pa.array([w for _, w in group], pa.string()), SLICE)


def table_matches(texts: DataFrame, listed: pa.Table, text_col: str, first: bool) -> DataFrame:
    """``group_matches`` for a table (pos, word) of distinct words."""
    listed = listed.sort_by([("pos", "ascending"), ("word", "ascending")]).combine_chunks()
    pos, word = (pa.concat_arrays(listed[c].chunks) for c in ("pos", "word"))
    table = WordTable(word.cast(pa.binary()))
    return _matched(texts, text_col, lambda rows: table.found(rows, first), pos, word, RUNS_SLICE)


def _matched(texts: DataFrame, text_col: str, found, pos: pa.Array, word: pa.Array, most: int) -> DataFrame:
    keep = [c for c in texts.columns if c != text_col]
    at = texts.columns.index(text_col)
    kept = [k for k in range(len(texts.columns)) if k != at]

    def match(batches):
        for b in _slices(batches, at, most):
            row, own = map(pa.array, found([(t or "").encode("utf-8", "surrogatepass") for t in b.column(at).to_pylist()]))
            yield pa.record_batch([*[b.column(k).take(row) for k in kept], pos.take(own), word.take(own)], names=[*keep, "pos", "word"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != text_col] + ["pos long", "word string"])
    return texts.mapInArrow(match, schema)


def _passes(texts: DataFrame, words: DataFrame, text_col: str, first: bool, most_states: int) -> Iterator[DataFrame]:
    """The written matches of the list: of one automaton, or of the parts of a
    longer list.  With more than one, the texts are written before, so that no
    pass joins or shuffles them again."""
    groups = list(islice(word_groups(words, most_states), 2))
    if len(groups) < 2:
        for group in groups:
            yield cut(group_matches(texts, group, text_col, first))
        return
    listed = cut(_listed(words))
    parts = -(-listed.count() // MOST_WORDS)
    own = cut(texts) if parts > 1 else texts
    for part in range(parts):
        yield cut(table_matches(own, listed.filter(F.pmod(F.xxhash64("word"), F.lit(parts)) == part).toArrow(), text_col, first), **REPEATS)


def word_matches(texts: DataFrame, words: DataFrame, text_col: str, most_states: int = MOST_STATES) -> DataFrame:
    """One row per text and word of ``words`` (pos, word) that it holds: the
    other columns of ``texts``, pos, word."""
    out = None
    for part in _passes(texts, words, text_col, False, most_states):
        out = part if out is None else out.unionByName(part)
    return _none(texts, text_col) if out is None else out


def first_words(texts: DataFrame, words: DataFrame, id_col: str, text_col: str, most_states: int = MOST_STATES) -> DataFrame:
    """The other columns of ``texts``, pos, word: for every text with a word of
    the list, the one with the smallest place (equal places: by word).  A list of one
    part shuffles no rows; with more, the firsts of each are compared by ``id_col``."""
    parts = list(_passes(texts, words, text_col, True, most_states))
    if len(parts) < 2:
        return parts[0] if parts else _none(texts, text_col)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return (out.groupBy(id_col).agg(F.min_by(F.struct(*[c for c in out.columns if c != id_col]), F.struct("pos", "word")).alias("_m"))
            .select(id_col, "_m.*").select(*out.columns))


def _none(texts: DataFrame, text_col: str) -> DataFrame:
    return texts.drop(text_col).limit(0).withColumn("pos", F.lit(0).cast("long")).withColumn("word", F.lit(""))
