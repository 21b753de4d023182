"""Encoder, range coder, token files and packing."""
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from murmur.llm import packing, rangecoder, tokenfile
from murmur.llm.tokens import Encoder, default_tokenizer


@pytest.fixture(scope="module")
def enc():
    return Encoder(default_tokenizer())


def ids_of(enc, text):
    return enc.tok.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t ab.'é漢　\x85\x1c<|>12", max_size=30), min_size=1, max_size=5))
def test_encoder_equals_the_library(texts):
    enc = _shared()
    got, n = enc.encode(pa.array(texts))
    want = [ids_of(enc, t) for t in texts]
    assert n.tolist() == [len(w) for w in want] and got.tolist() == sum(want, [])


_ONE = []


def _shared():
    if not _ONE:
        _ONE.append(Encoder(default_tokenizer()))
    return _ONE[0]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 3000), st.integers(1, 60_000), st.integers(0, 9))
def test_range_coder_round_trip(n, vocabulary, seed):
    r = np.random.default_rng(seed)
    ids = np.minimum(r.geometric(0.01, n) if seed % 2 else r.integers(0, vocabulary, n), vocabulary - 1).astype(np.int32)
    block = rangecoder.encode(ids)
    assert rangecoder.block_size(block + b"rest") == len(block)
    assert (rangecoder.decode(block) == ids).all()


def test_range_coder_compresses_and_finds_damage():
    ids = np.tile(np.arange(500, dtype=np.int32), 100)
    block = rangecoder.encode(ids)
    assert len(block) < len(ids) // 4
    for place in (40, 400, len(block) // 2, len(block) - 1):
        bad = bytearray(block)
        bad[place] ^= 4
        with pytest.raises(ValueError):
            rangecoder.decode(bytes(bad))


def test_crc_of_joined_parts():
    a, b = b"some bytes", b"and others" * 7
    assert tokenfile.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 25), min_size=2, max_size=24))
def test_plan_places_everything(counts):
    counts = np.array([0] + counts[1:], dtype=np.int64)
    used = np.zeros_like(counts)
    for copies, parts in packing.plan(counts):
        assert copies > 0 and sum(length * k for length, k in parts) <= len(counts) - 1
        for length, k in parts:
            used[length] += copies * k
    assert (used == counts).all()


def test_plan_is_close_to_the_lower_bound():
    r = np.random.default_rng(3)
    counts = np.bincount(np.clip(r.lognormal(5.5, 1.0, 20_000), 1, 2048).astype(int), minlength=2049)
    bins = sum(c for c, _ in packing.plan(counts))
    least = -(-int((counts * np.arange(2049)).sum()) // 2048)
    assert bins <= least * 1.002 + 1


def check_packed(rows, docs, enc):
    by, places = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seq in places.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 2048
    for doc, text in docs.items():
        ids = np.array(ids_of(enc, text), "<u4")
        pieces = sorted(by[doc], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        at = 0
        for p in pieces:
            assert p.start == at and zlib.crc32(ids[at:at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
        assert all(p.length == 2048 for p in pieces[1:]) and len(pieces) == -(-len(ids) // 2048)


def test_packing_of_documents(spark, sf_small, enc):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = packing.pack(docs).collect()
    check_packed(rows, {r.doc_id: r.text for r in docs.collect()}, enc)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 2048) + 2


def test_packing_of_odd_rows(spark, odd_docs, odd_rows, no_docs, enc):
    rows = packing.pack(odd_docs).collect()
    single = {i: t for i, t, *_ in odd_rows if i not in (None, 1)}
    check_packed([r for r in rows if r.doc_id in single] + [r for r in rows if r.doc_id not in single], single, enc)
    assert sum(r.doc_id == 1 and r.piece == 0 for r in rows) == 2
    assert sum(r.doc_id is None and r.piece == 0 for r in rows) == 2
    assert packing.pack(no_docs).count() == 0


def digests(spark, docs, path, **kw):
    tokenfile.write_tokens(docs, path, **kw)
    return tokenfile.document_digests(tokenfile.read_tokens(spark, path)).orderBy("start").collect()


def test_token_files(spark, sf_small, enc, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = digests(spark, docs, str(tmp_path / "t"))
    at = 0
    for g, d in zip(got, sorted(docs.collect(), key=lambda r: r.doc_id), strict=True):
        ids = np.array(ids_of(enc, d.text), "<u4")
        assert tuple(g) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_of_odd_rows_over_small_blocks(spark, odd_docs, odd_rows, no_docs, enc, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 20_000)
    monkeypatch.setattr(tokenfile, "BLOCKS_PER_FILE", 2)
    got = digests(spark, odd_docs, str(tmp_path / "t"))
    assert [g.doc_id for g in got][:2] == [None, None] and [g.doc_id for g in got][2:] == sorted(r[0] for r in odd_rows if r[0])
    text = {i: t for i, t, *_ in odd_rows if i is not None}
    at = 0
    for g in got:
        if g.doc_id is not None:
            ids = np.array(ids_of(enc, text[g.doc_id]), "<u4")
            assert (g.n_tokens, g.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
        assert g.start == at
        at += g.n_tokens
    assert digests(spark, no_docs, str(tmp_path / "none")) == []


ADDED = ["<|endoftext|>", "one<|endoftext|>two", "a text <|endoftext|> and more", "<|endoftext|><|endoftext|> x", "<|endoftext|",
         "two  spaces <|endoftext|>\n", "plain words only"]


def test_added_tokens_as_the_library_has_them(spark, tmp_path):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(default_tokenizer())
    want = [fresh.encode(t, add_special_tokens=False).ids + [0] for t in ADDED]
    assert sum(50256 in w for w in want) == 5
    got, n = Encoder(default_tokenizer()).encode(pa.array(ADDED))
    assert n.tolist() == [len(w) for w in want] and got.tolist() == sum(want, [])
    crc = [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]
    docs = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string").repartition(2)
    at = np.concatenate(([0], np.cumsum([len(w) for w in want])[:-1])).tolist()
    assert [tuple(g) for g in digests(spark, docs, str(tmp_path / "t"))] == list(zip(range(len(ADDED)), at, map(len, want), crc))
    assert {(r.doc_id, r.length, r.ids_crc32) for r in packing.pack(docs).collect()} == set(zip(range(len(ADDED)), map(len, want), crc))
