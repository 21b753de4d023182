"""Adaptive context-mixing range coder for token ids.

A block of ids is cut into parallel lanes that share one model and are coded in
lockstep, so every step is a handful of array operations.  For each id the
model has three predictions: the id that last followed the two ids before it
(order 2, hashed), the id that last followed the id before it (order 1), and
adaptive frequencies of all ids (order 0).  They are mixed by weights that adapt
in the context of both predictions' confidence and agreement:
P(id) = w2 [id = p2] + w1 [id = p1] + w0 P0(id), and the outcome drives a 64-bit
carry-less range coder per lane, which emits 32 bits at a time.  Encoder and
decoder make the same updates, so nothing of the model is stored; every block
starts from the empty model and carries a checksum of its ids."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"MTB1"
HEAD = 24
LANE_STEPS = 256
MAX_LANES = 8192
HASH_BITS = 18
MIX_BITS = 12
_U = np.uint64
_MIN = _U(1 << 32)        # a lane with a smaller range shifts out 32 bits
_LOW = _U(0xFFFFFFFF)


class _Model:
    """Predictions and weights; ``learn`` is called with the same arrays when
    encoding and when decoding.  A prediction is stored as 4 * id + confidence."""

    def __init__(self, vocabulary: int, decoding: bool):
        self.v, self.decoding = vocabulary, decoding
        self.bits = max(16, (vocabulary - 1).bit_length() + 2)
        self.p1, self.p2 = np.zeros(vocabulary, np.int32), np.zeros(1 << HASH_BITS, np.int32)
        self.mix = np.ones((32, 3))
        self.mix[1::2, 1] = 0           # both predict the same id: the second cannot be it alone
        self.count0 = np.zeros(vocabulary, np.int64)
        self.pending, self.n_pending, self.n0, self.steps = [], 0, 0, 0
        self._weights()
        self._order0()

    def _weights(self):
        total = 1 << MIX_BITS
        f = np.floor(self.mix / self.mix.sum(axis=1, keepdims=True) * (total - 8)).astype(np.uint64) + _U(1)
        f[1::2, 1] = 0
        self.f2, self.f1 = np.ascontiguousarray(f[:, 0]), np.ascontiguousarray(f[:, 1])
        if self.mix.sum() > 1 << 22:
            self.mix *= 0.5

    def _order0(self):
        total = 1 << self.bits
        f = 1 + self.count0 * (total - self.v) // max(1, int(self.count0.sum()))
        c = np.concatenate(([0], np.cumsum(f)))
        self.freq, self.cum = f.astype(np.uint64), c[:-1].astype(np.uint64)
        if self.decoding:
            f[-1] += total - c[-1]
            self.slot = np.repeat(np.arange(self.v, dtype=np.int32), f)

    def predict(self, a: np.ndarray, b: np.ndarray):
        """For the ids before (a) and before that (b)."""
        self.i1 = a
        self.i2 = (a * 40503 + b * 30011) & ((1 << HASH_BITS) - 1)
        self.v1, self.v2 = self.p1[a], self.p2[self.i2]
        self.s1, self.s2 = self.v1 & 3, self.v2 & 3
        self.c1, self.c2 = self.v1 >> 2, self.v2 >> 2
        self.ctx = (self.s2 << 3) + (self.s1 << 1) + (self.c1 == self.c2)
        return self.f2[self.ctx], self.f1[self.ctx]

    def learn(self, ids: np.ndarray, hit1: np.ndarray, hit2: np.ndarray, escape: np.ndarray, escaped: np.ndarray):
        """A prediction that held gains confidence, one that failed loses it and
        gives way when it has little.  Both orders learn from every id; the mixing
        counts too, and the weights follow them every fourth step."""
        self.p1[self.i1] = np.where(hit1, self.v1 + (self.s1 < 3), np.where(self.s1 > 1, self.v1 - self.s1 + 1, ids << 2))
        self.p2[self.i2] = np.where(hit2, self.v2 + (self.s2 < 3), np.where(self.s2 > 1, self.v2 - self.s2 + 1, ids << 2))
        self.steps += 1
        self.mix += np.bincount(self.ctx * 3 + np.where(hit2, 0, 1 + escape), minlength=96).reshape(32, 3)
        if self.steps < 16 or self.steps % 4 == 0:
            self._weights()
        self.pending.append(escaped)
        self.n_pending += len(escaped)
        if self.n_pending >= min(max(512, self.n0 // 4), 1 << 17):
            self.count0 += np.bincount(np.concatenate(self.pending), minlength=self.v)
            self.n0 += self.n_pending
            self.pending, self.n_pending = [], 0
            self._order0()


def _narrow(low, rng):
    """Range of the lanes that are to shift: cut back where it straddles a
    multiple of 2^32."""
    cross = ((low ^ (low + rng - _U(1))) >> _U(32)) != 0
    return np.where(cross, (~low & _LOW) + _U(1), rng)


def _layout(n: int) -> tuple[int, int]:
    lanes = min(MAX_LANES, max(1, n // LANE_STEPS))
    return lanes, -(-n // lanes) if n else 0


def encode(ids: np.ndarray) -> bytes:
    """One self-contained block."""
    n = len(ids)
    lanes, steps = _layout(n)
    vocabulary = int(ids.max()) + 1 if n else 1
    grid = np.zeros(lanes * steps, dtype=np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T) if steps else grid.reshape(0, lanes)
    m = _Model(vocabulary, False)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    words, ptr = np.zeros((lanes, steps + 2), np.uint32), np.zeros(lanes, np.int64)
    a = b = np.zeros(lanes, np.int32)
    for x in grid:
        f2, f1 = m.predict(a, b)
        hit2, hit1 = x == m.c2, x == m.c1
        r = rng >> _U(MIX_BITS)
        t2, d1 = r * f2, r * f1
        escape = ~(hit1 | hit2)
        low += np.where(hit2, _U(0), t2 + d1 * escape)
        rng = np.where(hit2, t2, np.where(escape, rng - t2 - d1, d1))
        esc = np.flatnonzero(escape)
        y = x[esc]
        r = rng[esc] >> _U(m.bits)
        low[esc] += r * m.cum[y]
        rng[esc] = r * m.freq[y]
        at = np.flatnonzero(rng < _MIN)
        z = low[at]
        words[at, ptr[at]] = z >> _U(32)
        ptr[at] += 1
        rng[at] = _narrow(z, rng[at]) << _U(32)
        low[at] = z << _U(32)
        m.learn(x, hit1, hit2, escape, y)
        a, b = x, a
    everyone = np.arange(lanes)
    words[everyone, ptr] = low >> _U(32)
    words[everyone, ptr + 1] = low & _LOW
    ptr += 2
    body = words[np.arange(words.shape[1])[None, :] < ptr[:, None]].astype("<u4").tobytes()
    raw = np.asarray(ids).astype("<u4").tobytes()
    coded = ptr.astype("<u4").tobytes() + body
    return MAGIC + struct.pack("<IIIII", n, vocabulary, zlib.crc32(raw), len(body), zlib.crc32(coded)) + coded


def block_size(data, at: int = 0) -> int:
    """Bytes of the block that starts at ``at``."""
    magic, (n, _, _, body, _) = bytes(data[at:at + 4]), struct.unpack_from("<IIIII", data, at + 4)
    if magic != MAGIC:
        raise ValueError("not a token block")
    return HEAD + 4 * _layout(n)[0] + body


def decode(data: bytes) -> np.ndarray:
    """The ids of one block; ValueError if a checksum (of the coded bytes, of the
    ids) does not hold."""
    n, vocabulary, crc, body, coded = struct.unpack_from("<IIIII", data, 4)
    if len(data) < block_size(data) or zlib.crc32(memoryview(data)[HEAD:block_size(data)]) != coded:
        raise ValueError("token block is damaged")
    lanes, steps = _layout(n)
    count = np.frombuffer(data, "<u4", lanes, HEAD).astype(np.int64)
    words = np.frombuffer(data, "<u4", body // 4, HEAD + 4 * lanes).astype(np.uint64)
    words = np.concatenate((words, np.zeros(2, np.uint64)))
    ptr = np.concatenate(([0], np.cumsum(count)[:-1]))
    x = (words[ptr] << _U(32)) | words[ptr + 1]
    ptr += 2
    m = _Model(vocabulary, True)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    a = b = np.zeros(lanes, np.int32)
    out = np.zeros((steps, lanes), np.int32)
    top = _U((1 << m.bits) - 1)
    for t in range(steps):              # x: what the stream has above low
        f2, f1 = m.predict(a, b)
        r = rng >> _U(MIX_BITS)
        t2, d1 = r * f2, r * f1
        hit2 = x < t2
        escape = x >= t2 + d1
        add = np.where(hit2, _U(0), t2 + d1 * escape)
        low += add
        x -= add
        rng = np.where(hit2, t2, np.where(escape, rng - t2 - d1, d1))
        ids = np.where(hit2, m.c2, m.c1)
        esc = np.flatnonzero(escape)
        r = rng[esc] >> _U(m.bits)
        y = m.slot[np.minimum(x[esc] // r, top).view(np.int64)]
        ids[esc] = y
        add = r * m.cum[y]
        low[esc] += add
        x[esc] -= add
        rng[esc] = r * m.freq[y]
        at = np.flatnonzero(rng < _MIN)
        z = low[at]
        rng[at] = _narrow(z, rng[at]) << _U(32)
        low[at] = z << _U(32)
        x[at] = (x[at] << _U(32)) | words[np.minimum(ptr[at], len(words) - 1)]
        ptr[at] += 1
        m.learn(ids, ids == m.c1, hit2, escape, y)
        out[t] = ids
        a, b = ids, a
    flat = out.T.reshape(-1)[:n].astype(np.uint32)
    if zlib.crc32(flat.astype("<u4").tobytes()) != crc:
        raise ValueError("token block is damaged")
    return flat
