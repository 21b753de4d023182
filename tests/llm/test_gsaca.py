"""The grouping suffix sorter equals a plain sort of the suffixes."""
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from murmur.llm.gsaca import suffix_arrays
from murmur.llm.suffix_words import adjacent_lcp, longest_repeat_at, suffix_array


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=24), max_size=6))
def test_grouping_sorter(strings):
    text = np.array([c for s in strings for c in s], dtype=np.uint8)
    start = np.concatenate(([0], np.cumsum([len(s) for s in strings]))).astype(np.int64)
    want = [start[k] + i for k, s in enumerate(strings) for i in sorted(range(len(s)), key=lambda i: s[i:])]
    assert suffix_arrays(text, start).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=24), max_size=5))
def test_word_suffix_array_and_lcp(texts):
    codes = np.array([c for t in texts for c in t], dtype=np.int64)
    end = np.cumsum([len(t) for t in texts])
    text_end = np.repeat(end, [len(t) for t in texts]).astype(np.int64)
    sa, ranks = suffix_array(codes, text_end)
    want = [e - len(t) + i for t, e in zip(texts, end) for i in sorted(range(len(t)), key=lambda i: t[i:])]
    assert sa.tolist() == want
    got = longest_repeat_at(sa, adjacent_lcp(sa, ranks, text_end)).tolist()

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    brute = [max((common(t[i:], t[j:]) for j in range(len(t)) if j != i), default=0) for t in texts for i in range(len(t))]
    assert got == brute
