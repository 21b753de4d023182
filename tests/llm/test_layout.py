"""Sharding, archives and chat."""
import hashlib
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from llm_helpers import extra
from murmur.llm import chat, sharding, warc


def check_shards(rows, shards=40):
    by = {}
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_sharding_of_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = sharding.shard_documents(docs).collect()
    check_shards(rows)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))


def shards_of(spark, texts, shards):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sharding.shard_documents(df, shards=shards)
    rows = got.collect()
    check_shards(rows, shards)
    where = {}
    for x in rows:
        where.setdefault(texts[x.doc_id], Counter())[x.shard] += 1
    return where, sharding.cut_edges(got).first()


def test_a_group_larger_than_a_shard_fills_whole_shards(spark):
    r = random.Random(2)
    texts = [f"copy {g}" for g in range(30) for _ in range(r.randint(2, 6))] + ["big"] * 260 + [f"single {i}" for i in range(600)]
    where, _ = shards_of(spark, texts, 10)
    assert sum(k for _, k in where["big"].most_common(3)) >= 0.95 * 260       # a shard holds 98 rows
    assert sum(len(v) > 1 for k, v in where.items() if k.startswith("copy")) <= 3


def test_groups_gather_where_every_row_is_linked(spark):
    """No rows without links make room: shards exchange groups until none can move."""
    texts = [f"copy {g}" for g in range(1500) for _ in range(2 + g % 3)]
    where, (linked, lost) = shards_of(spark, texts, 10)
    assert sum(len(v) > 1 for v in where.values()) <= 30 and 50 * lost <= linked


def least_cut(sizes, shards):
    """Fewest pairs of copies in different shards over all ways to deal groups of
    these sizes to shards whose counts differ by at most one."""
    total = sum(sizes)
    share = sorted([total // shards + (i < total % shards) for i in range(shards)], reverse=True)

    def deals(n, room):
        if len(room) == 1:
            if n <= room[0]:
                yield (n,)
            return
        for k in range(min(n, room[0]) + 1):
            for rest in deals(n - k, room[1:]):
                yield (k, *rest)

    best = {tuple(share): 0}
    for n in sizes:
        after = {}
        for room, cost in best.items():
            for d in deals(n, room):
                left = tuple(r - k for r, k in zip(room, d))
                lost = cost + (n * (n - 1) - sum(k * (k - 1) for k in d)) // 2
                if lost < after.get(left, lost + 1):
                    after[left] = lost
        best = after
    return min(best.values())


def test_cut_against_the_best_deal(spark):
    """The cut of small groups against the least that any deal allows."""
    r = random.Random(11)
    for sizes, shards, found in (([9, 1, 1, 1], 2, True), ([5, 5, 2], 3, True), ([3] * 6 + [1] * 6, 3, True),
                                 ([r.randint(2, 7) for _ in range(12)], 3, False)):
        texts = [f"copy {g}" for g, n in enumerate(sizes) for _ in range(n)]
        _, (linked, lost) = shards_of(spark, texts, shards)
        least = least_cut(sizes, shards)
        assert least <= lost
        assert lost == least if found else 4 * (lost - least) <= linked


def test_sharding_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    rows = sharding.shard_documents(odd_docs).collect()
    check_shards(rows)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in odd_rows)
    assert {r["size"] for r in rows if r.doc_id == 2} == {16} and {r["size"] for r in rows if r.doc_id == 9} == {16 + len(odd_rows[11][1].encode())}
    assert sharding.shard_documents(no_docs).count() == 0


PAGES = "page_id long, url string, html string"


def test_archives_round_trip_of_odd_rows(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/ b\n", big), (2, None, big), (3, "u", big + "x"), (4, "u", "small"), (5, "u", "small"),
            (6, "u", None), (7, "u", ""), (None, "u", big), (None, "u", "y" * 1200), (8, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 90),
            (9, "u", "z" * 999), (10, "u", "z" * 999), (11, "u", "q" * 1000), (11, "u", "q" * 1000), (12, "u", "\r\n\r\n")]
    df = extra(spark.createDataFrame(rows, PAGES).repartition(2))
    path = str(tmp_path / "w")
    warc.write_archives(df, path)
    rec = warc.read_archives(spark, path)
    got = warc.resolve(rec).collect()
    assert len(got) == len(rows)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == raw and j is not None]
        top = max(same, default=None)
        revisit = len(raw) >= 1000 and top is not None and i != top
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    uris = {r.page_id: r.target_uri for r in rec.filter("page_id < 3").collect()}
    assert uris == {1: "http://a/%20b%20", 2: None}


def test_responses_keep_their_place(spark):
    """Payloads that the filter takes for revisits come through, by either way,
    and payloads are not shuffled unless they are many."""
    rows = [(i, "u", f"{i % 700} " * 600) for i in range(1000)] + [(None, "u", "5 " * 600), (None, "u", "alone " * 300)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    rec = warc._records(pages, "page_id", "url", "html")
    headers = warc.cut(rec.drop("_m_payload"))
    again = warc.cut(warc.revisits(headers))
    assert again.count() == 301
    want = sorted([*range(300, 1000), 10**6])
    narrow = warc.responses(rec, headers, again.limit(0).unionByName(again), few=10**6, most_words=1024)
    assert sorted(10**6 if x._m_id is None else x._m_id for x in narrow.collect()) == want
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan.split("== Initial Plan ==")[0]
    # a filter of one block that holds all headers: everything is held back
    full = headers.withColumn("_m_original", warc.F.lit(0))
    bits = warc.cut(warc.bloom_bits(full.select(warc._key().alias("h")), 1024, least=1))
    for few in (10**6, 0):
        got = held_back(warc, bits, rec, headers, again, few)
        assert sorted(10**6 if x._m_id is None else x._m_id for x in got) == want


def held_back(module, bits, rec, headers, again, few):
    real = module.bloom_bits
    module.bloom_bits = lambda *a, **k: bits
    try:
        return module.responses(rec, headers, again, few=few, most_words=1024).collect()
    finally:
        module.bloom_bits = real


def test_archives_of_very_long_payloads(spark, tmp_path):
    """Two copies of 12 MB and a short row; files of at most two records."""
    long = "<p>word</p>\r\n\r\n" * 800_000
    rows = [(1, "u", long), (2, "u", long), (3, "u", "x")]
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path / "w"), file_records=2)
    got = {r.page_id: r for r in warc.resolve(warc.read_archives(spark, str(tmp_path / "w"))).collect()}
    sha = hashlib.sha1(long.encode()).hexdigest()
    assert [(got[i].record_type, got[i].refers_to, got[i].payload_bytes) for i in (1, 2, 3)] == [
        ("revisit", 2, len(long)), ("response", None, len(long)), ("response", None, 1)]
    assert got[1].payload_digest == got[2].payload_digest == sha


def test_archives_of_no_rows(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert warc.resolve(warc.read_archives(spark, str(tmp_path / "w"))).count() == 0


def test_parser_over_small_pieces():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nab\r\n\r\ncde\r\n\r\n"
    data = one * 3
    for size in (1, 2, 5, 1000):
        got = list(warc.parse(data[i:i + size] for i in range(0, len(data), size)))
        assert [b for _, b in got] == [b"ab\r\n\r\ncde"] * 3


TURNS = "conv_id long, turn long, role string, text string"


def brute_chat(rows):
    conv = {}
    for c, t, r, x in set(rows):
        conv.setdefault(c, []).append((t, r, x))
    key = lambda y: tuple((v is not None, v if v is not None else 0) for v in y)      # noqa: E731
    conv = {c: tuple(y[1:] for y in sorted(v, key=key)) for c, v in conv.items()}
    out = set()
    for c, v in conv.items():
        longer = any(o != c and w[:len(v)] == v and len(w) > len(v) for o, w in conv.items())
        same = [o for o, w in conv.items() if w == v and o is not None]
        first = min(same, default=None)
        if not longer and c == first:
            out |= {(c, i + 1, len(v), r, f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n") for i, (r, x) in enumerate(v)}
    return out


def test_chat_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_TURNS", 3)
    r = random.Random(8)
    rows = []
    for c in range(40):
        base = r.randint(0, 5)
        for t in range(r.randint(1, 12)):
            rows.append((c, t, "user" if t % 2 else "assistant", f"{base} {t}" if r.random() < 0.97 else f"own {c}"))
    rows += rows[:5]
    rows += [(50, 0, None, "x"), (50, 1, "user", None), (51, 0, "", "x"), (51, 1, "user", ""), (52, None, "user", "first"),
             (52, 0, "user", "then"), (53, 4, "b", "tie"), (53, 4, "a", "tie"), (None, 0, "user", "lost"), (None, 1, "user", "more"),
             (54, 0, "user", "lost"), (55, -7, "user", "early"), (55, 900, "user", "late")]
    df = extra(spark.createDataFrame(rows, TURNS).repartition(3))
    got = chat.render(df)
    assert {tuple(x) for x in got.collect()} == brute_chat(rows)
    texts = {x.conv_id: x.text for x in chat.conversation_texts(got).collect()}
    assert texts[53] == "<|im_start|>a\ntie<|im_end|>\n<|im_start|>b\ntie<|im_end|>\n"
    assert chat.render(spark.createDataFrame([], TURNS)).count() == 0


def test_one_huge_conversation(spark):
    df = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                  F.concat(F.lit("t"), F.col("id")).alias("text"))
    part = df.filter("turn < 700").withColumn("conv_id", F.lit(2).cast("long"))
    got = chat.render(df.unionByName(part))
    assert got.count() == 5000 and got.select("conv_id").distinct().collect()[0][0] == 1
