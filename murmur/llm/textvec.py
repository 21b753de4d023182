"""Vectorised word handling for Python tasks: whole texts as UTF-8 bytes.

A word is a maximal run of bytes other than space and \\x09-\\x0D; those are
single bytes in UTF-8, so bytes and characters split at the same places.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc

PIECE = 1 << 20   # bytes hashed at a time (bounds the scratch arrays, not the text)
_MASK = (1 << 64) - 1

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64 (a bijection on 64-bit integers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class PolyHash:
    """Hashes of many substrings of one byte string from one prefix-sum pass.

    sum(T[byte] * B^i) modulo 2^64 with random odd B and random T, shifted to
    the origin by the inverse power; equal substrings get equal hashes."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        self.table = r.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(r.integers(0, 2**63)) * 2 + 1
        self.inv = pow(self.base, -1, 1 << 64)
        self.pw = self.ipw = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.pw) < n + 1:
            size = max(n + 1, 1 << 16)
            for name, b in (("pw", self.base), ("ipw", self.inv)):
                v = np.full(size, b, dtype=np.uint64)
                v[0] = 1
                setattr(self, name, np.cumprod(v, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """S with S[j] - S[i] the unshifted hash of data[i:j]."""
        self._grow(len(data))
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * self.pw[:len(data)], out=out[1:], dtype=np.uint64)
        return out

    def spans(self, s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (s[end] - s[start]) * self.ipw[start]


def join_texts(texts: list) -> tuple[bytes, np.ndarray]:
    """One byte string with a newline after each text (null: empty), and the
    start of each text in it plus the end."""
    parts = [(t or "").encode("utf-8", "surrogatepass") if not isinstance(t, bytes) else t for t in texts]
    at = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=at[1:])
    return b"\n".join(parts) + b"\n" if parts else b"", at


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``data`` (in pieces, so scratch is bounded)."""
    a = np.frombuffer(data, dtype=np.uint8)
    starts, ends = [], []
    last = False
    for p in range(0, len(a), PIECE):
        w = ~_SPACE[a[p:p + PIECE]]
        before = np.empty_like(w)
        before[0], before[1:] = last, w[:-1]
        edge = np.flatnonzero(w != before) + p
        kind = w[edge - p]
        starts.append(edge[kind])
        ends.append(edge[~kind])
        last = bool(w[-1])
    if last:
        ends.append(np.array([len(a)]))
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(starts + none), np.concatenate(ends + none)


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, poly: PolyHash) -> np.ndarray:
    """64-bit hash of every word; pieces are cut between words."""
    a = np.frombuffer(data, dtype=np.uint8)
    out = np.zeros(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        s = poly.prefix(a[lo:hi])
        out[i:j] = poly.spans(s, starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return mix64(out)


def text_slices(batches, text: int, limit: int = 1 << 21):
    """Slices of Arrow record batches whose texts (column ``text``) hold about
    ``limit`` bytes; one longer text is a slice of its own."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False) + 16)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + limit, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def text_batches(batches, columns: int, text: int, limit: int = 1 << 21):
    """The first ``columns`` columns of such slices as Python lists."""
    for b in text_slices(batches, text, limit):
        yield [b.column(k).to_pylist() for k in range(columns)]
