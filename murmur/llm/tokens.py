"""Token ids of whole texts by the ``tokenizers`` library, inside Python tasks.

A byte-level BPE of this kind splits a text before its merges, and never joins
anything over a single space that has a non-space character on either side.  So
a text is cut at those spaces, every distinct cut piece is encoded by the
library once, and its ids are reused wherever the piece comes again.  A text
that holds the string of an added token goes to the library whole."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textvec import PolyHash, mix64, text_slices

END_ID = 0
MEMO_PIECES = 1_500_000     # distinct pieces that a worker remembers before it starts afresh
MEMO_IDS = 8_000_000       # and how many ids of them

_WHITE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = rf" [{_WHITE}]|[{_WHITE}] |\A | \z"


def per_worker(key, build):
    """One object for each Python worker process and key: tasks that follow each
    other on a worker share it."""
    store = sys.modules.setdefault("murmur_worker_objects", types.ModuleType("murmur_worker_objects")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # the task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.odd = "|".join([_ODD, *("".join(rf"\x{{{ord(c):x}}}" for c in t) for t in added)])
        vocabulary = self.tok.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():         # byte-level: one character of the token for each byte
            self.bytes[i] = len(token)
        self.poly = (PolyHash(21), PolyHash(22))
        self._reset()

    def _reset(self):
        # pieces at the start of a text, pieces after a space: sorted hashes and codes
        self.memo = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.off, self.len = np.zeros(1 << 14, dtype=np.int32), np.zeros(1 << 14, dtype=np.int32)
        self.n = self.used = 0

    def _learn(self, pieces: pa.Array, spaced: int):
        """Encode new pieces: those that follow a space many at a time as one
        text, whose ids are dealt out again by their lengths in bytes."""
        end = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False) + 1)
        part = pieces.to_pylist()
        if spaced:
            got = self.tok.encode_batch_fast([" " + " ".join(part[i:i + 64]) for i in range(0, len(part), 64)],
                                             add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, dtype=np.int32) for e in got])
            till = np.cumsum(self.bytes[ids])
            at = np.concatenate(([0], np.searchsorted(till, end) + 1))
            if not (till[at[1:] - 1] == end).all():
                raise ValueError("the tokenizer joins over a space between words")
        else:
            got = self.tok.encode_batch_fast(part, add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, dtype=np.int32) for e in got])
            at = np.concatenate(([0], np.cumsum([len(e.ids) for e in got])))
        k = len(part)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.n + k > len(self.off):
            self.off, self.len = (np.concatenate((a, np.zeros_like(a))) for a in (self.off, self.len))
        self.ids[self.used:self.used + len(ids)] = ids
        self.off[self.n:self.n + k], self.len[self.n:self.n + k] = at[:-1] + self.used, np.diff(at)
        self.n += k
        self.used += len(ids)

    def _hashes(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of every piece."""
        end = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False))
        start = np.concatenate(([0], end[:-1]))
        raw = pa.concat_arrays([pieces.cast(pa.large_binary())]).buffers()
        first = np.frombuffer(raw[1], np.int64)[pieces.offset] if len(pieces) else 0
        data = np.frombuffer(raw[2], np.uint8)[first:first + end[-1]]
        out = np.empty((2, len(pieces)), np.uint64)
        i = 0
        while i < len(pieces):
            j = max(i + 1, int(np.searchsorted(end, start[i] + (1 << 20), "right")))
            part = data[start[i]:end[j - 1]]
            for k, poly in enumerate(self.poly):
                s = poly.prefix(part)
                out[k, i:j] = mix64(poly.spans(s, start[i:j] - start[i], end[i:j] - start[i]))
            i = j
        return out[0], out[1]

    def _codes(self, pieces: pa.Array, spaced: int) -> np.ndarray:
        """Codes of distinct pieces: those met before are found by their hashes."""
        h1, h2 = self._hashes(pieces)
        k1, k2, known = self.memo[spaced]
        codes = np.full(len(h1), -1, dtype=np.int64)
        if len(k1):
            at = np.minimum(np.searchsorted(k1, h1), len(k1) - 1)
            codes = np.where((k1[at] == h1) & (k2[at] == h2), known[at], -1)
        gap = np.flatnonzero(codes < 0)
        for p in range(0, len(gap), 40_000):
            at = gap[p:p + 40_000]
            codes[at] = np.arange(self.n, self.n + len(at))
            self._learn(pieces.take(pa.array(at)), spaced)
        if len(gap):
            order = gap[np.argsort(h1[gap])]
            k1, k2, known = (np.concatenate(x) for x in ((k1, h1[order]), (k2, h2[order]), (known, codes[order])))
            order = np.argsort(k1, kind="stable")       # two sorted runs
            self.memo[spaced] = (k1[order], k2[order], known[order])
        return codes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by END_ID, and the number of ids of
        each with it (null: empty text)."""
        if self.used > MEMO_IDS or self.n > MEMO_PIECES:
            self._reset()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        # a text with a space beside white space or at an end, or with an added token, goes to the library whole
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False))
        whole = None
        if len(odd):
            whole = [np.array(e.ids, dtype=np.int32) for e in
                     self.tok.encode_batch_fast(texts.take(pa.array(odd)).to_pylist(), add_special_tokens=False)]
            keep = np.ones(len(texts), dtype=bool)
            keep[odd] = False
            texts = pc.if_else(pa.array(keep), texts, "")
        cut = pc.split_pattern(texts, " ")
        start = cut.offsets.to_numpy().astype(np.int64)
        start -= start[0]
        coded = cut.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary
        first = np.zeros(len(index), dtype=bool)
        first[start[:-1]] = True
        codes = np.empty(len(index), dtype=np.int64)
        for spaced, mine in ((0, first), (1, ~first)):
            own = index[mine]
            used = np.flatnonzero(np.bincount(own, minlength=len(words)))
            table = np.zeros(len(words), dtype=np.int64)
            if len(used):
                table[used] = self._codes(words.take(pa.array(used)), spaced)
            codes[mine] = table[own]
        lens = self.len[codes].astype(np.int64)
        till = np.concatenate(([0], np.cumsum(lens)))
        n = till[start[1:]] - till[start[:-1]] + 1
        if whole is not None:
            n[odd] = [len(x) + 1 for x in whole]
        out = np.full(int(n.sum()), END_ID, dtype=np.int32)
        at = np.cumsum(n) - n
        # a piece's ids go to its place in its text
        piece_at = np.repeat(at - till[start[:-1]], np.diff(start)) + till[:-1]
        step = np.arange(till[-1], dtype=np.int32)
        src = self.ids[np.repeat((self.off[codes] - till[:-1]).astype(np.int32), lens) + step]
        out[np.repeat((piece_at - till[:-1]).astype(np.int32), lens) + step] = src
        for i, x in zip(odd.tolist(), whole or ()):
            out[at[i]:at[i] + len(x)] = x
        return out, n


def encoder(path: str) -> Encoder:
    return per_worker(("encoder", path), lambda: Encoder(path))


def slices(batches, limit: int = 2 << 20):
    """(ids column, texts column) of Arrow batches of (_m_id, _m_text), in slices
    of about ``limit`` bytes of text."""
    for b in text_slices(batches, 1, limit):
        yield b.column(0), b.column(1)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
