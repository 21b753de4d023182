"""Quality rules by suffix-array repetition (operator 10).

Words are runs without white space.  Base rules: at least 50 words, and at most
half of the words in 3-word windows that occur twice or more.  The method: a
suffix array over the words of each text with its LCPs; the LCP intervals give
the maximal repeated substrings, those of at least ``min_repeat`` words mark
their spans (all occurrences, the first included), and a text is kept if the
union of the spans covers at most ``max_covered`` percent of its words and the
longest repeat has at most ``max_longest`` words and at most
``max_longest_percent`` percent of the text's.  The defaults follow published
practice for repeated 10-word strings (10 to 20 percent of a text).

Edge cases: a null or empty text has no words and fails the base rule; rows
without doc_id and repeated rows are judged like any other; empty input gives
no rows; other columns of the input are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, input_tasks
from .suffix_words import adjacent_lcp, covered, longest_repeat_at, suffix_array
from .textvec import PolyHash, join_texts, text_batches, text_slices, word_hashes, word_spans

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50     # words in repeated 3-word windows
MIN_REPEAT = 10             # words of a repeated substring that counts
MAX_COVERED = 20            # percent of the words inside such substrings
MAX_LONGEST = 200           # words of the longest such substring
MAX_LONGEST_PERCENT = 10    # the same in percent of the text's words
SYMBOLS = b"#*$%&|<>"

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, covered_words long, longest_repeat long")


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def judge(ids, texts, poly, min_repeat, max_covered, max_longest, max_longest_percent) -> pa.RecordBatch:
    n = len(texts)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data, at = join_texts(raw)
    starts, ends = word_spans(data)
    _, codes = np.unique(word_hashes(data, starts, ends, poly), return_inverse=True)
    word_at = np.searchsorted(starts, at)
    n_words = np.diff(word_at)
    text_end = np.repeat(word_at[1:], n_words)
    sa, ranks = suffix_array(codes, text_end)
    longest = longest_repeat_at(sa, adjacent_lcp(sa, ranks, text_end))

    total = len(codes)

    def per_text(mark):
        s = np.concatenate(([0], np.cumsum(mark)))
        return s[word_at[1:]] - s[word_at[:-1]]

    three = np.flatnonzero(longest >= 3)
    repeat = per_text(covered(three, np.full(len(three), 3), total))
    long = np.flatnonzero(longest >= min_repeat)
    cover = per_text(covered(long, longest[long], total))
    top = np.zeros(n, dtype=np.int64)
    some = n_words > 0
    if total:
        top[some] = np.maximum.reduceat(longest, word_at[:-1][some])
    # code points in words: bytes of words that do not continue a character
    a = np.frombuffer(data, dtype=np.uint8)
    follow = np.concatenate(([0], np.cumsum((a & 0xC0) == 0x80)))
    size = np.concatenate(([0], np.cumsum(ends - starts)))
    chars = (size[word_at[1:]] - size[word_at[:-1]]) - (follow[at[1:]] - follow[at[:-1]])
    symbols = np.array([len(r) - len(r.translate(None, SYMBOLS)) for r in raw], dtype=np.int64)
    dup = np.array([_dup_lines(r) for r in raw], dtype=np.int64)
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    short = (top < min_repeat) | ((top <= max_longest) & (100 * top <= max_longest_percent * n_words))
    kept = ~failed & (100 * cover <= max_covered * n_words) & short
    cols = [pa.array(ids, pa.int64())] + [pa.array(x.astype(np.int64)) for x in (n_words, chars, symbols, dup, repeat)]
    cols += [pa.array(failed), pa.array(kept), pa.array(cover.astype(np.int64)), pa.array(top)]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])


def quality(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: int = MAX_COVERED,
            max_longest: int = MAX_LONGEST, max_longest_percent: int = MAX_LONGEST_PERCENT,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the counts, the base verdict, and ``kept``, with
    the words inside maximal repeats and the longest repeat beside them.  No
    shuffle: each text is judged where it was read."""
    def run(batches):
        poly = PolyHash(11)
        for ids, texts in text_batches(batches, 2, 1):
            yield judge(ids, texts, poly, min_repeat, max_covered, max_longest, max_longest_percent)

    return input_tasks(documents_of(docs, id_col, text_col)).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns as in ``docs``: the
    verdict is made where the row was read, so nothing is joined or shuffled."""
    names = docs.columns
    spread = input_tasks(docs)
    used = [limits.get(k, v) for k, v in (("min_repeat", MIN_REPEAT), ("max_covered", MAX_COVERED),
                                          ("max_longest", MAX_LONGEST), ("max_longest_percent", MAX_LONGEST_PERCENT))]
    text = names.index("text")

    def run(batches):
        poly = PolyHash(11)
        for b in text_slices(batches, text):
            verdict = judge([None] * b.num_rows, b.column(text).to_pylist(), poly, *used)
            yield b.filter(verdict.column(7))

    return spread.mapInArrow(run, docs.schema)
