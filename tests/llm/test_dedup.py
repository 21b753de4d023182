"""Deduplication operators against brute force, and their odd rows."""
import hashlib
import random

import numpy as np
import xxhash

from murmur.llm import lines, simhash, substrings


# --- repeated substrings -------------------------------------------------

def brute_substrings(docs, length=100):
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda r: r[0]):
        raw = (text or "").encode()
        mark = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w in seen:
                mark[i:i + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(b for b, m in zip(raw, mark) if not m)
        runs = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        out[doc] = (len(raw), sum(mark), runs, hashlib.sha256(kept).hexdigest())
    return out


def made_texts(seed, n=100):
    r = random.Random(seed)
    base = ["".join(r.choice("ab") for _ in range(300)) for _ in range(5)]
    docs = []
    for i in range(n):
        t = ""
        for _ in range(r.randint(0, 4)):
            p = r.randint(0, 200)
            t += r.choice(base)[p:p + r.randint(30, 250)]
            if r.random() < 0.3:
                t += "".join(r.choice("ab c") for _ in range(r.randint(1, 60)))
        docs.append((i, "a" * r.randint(0, 300) if r.random() < 0.1 else t))
    return docs + [(n + 1, None), (n + 2, ""), (n + 3, "é" * 120), (n + 4, "é" * 130)]


def run_substrings(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return {r[0]: tuple(r[1:]) for r in substrings.dedup_substrings(df).collect()}


def test_substrings_equal_brute_force(spark):
    docs = made_texts(1)
    assert run_substrings(spark, docs) == brute_substrings(docs)


def test_substrings_with_divided_groups_and_small_buffers(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", 4)
    monkeypatch.setattr(substrings, "BUFFER", 700)
    docs = made_texts(2)
    assert run_substrings(spark, docs) == brute_substrings(docs)


def test_substrings_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    rows = substrings.dedup_substrings(odd_docs, with_bytes=True).collect()
    assert len(rows) == len(odd_rows)
    got = {r.doc_id: tuple(r)[1:5] for r in rows if r.doc_id is not None}
    named = [(i, t) for i, t, *_ in odd_rows if i is not None]
    # the texts without id come before all others
    loose = [(-2 + k, t) for k, (i, t, *_) in enumerate(r for r in odd_rows if r[0] is None)]
    want = brute_substrings(loose + list(dict(named).items()))
    assert got == {k: want[k] for k in got}
    assert sum(r.doc_id == 1 for r in rows) == 2 and len({tuple(r) for r in rows if r.doc_id == 1}) == 1
    assert substrings.dedup_substrings(no_docs).count() == 0


# --- SimHash ---------------------------------------------------------------

def brute_fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints):
    """{doc: smallest doc linked over chains}."""
    docs = sorted(prints)
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(docs):
        for b in docs[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in docs}


def test_simhash_equals_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    want = brute_components(prints)
    got = simhash.simhash_groups(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{prints[d]:016x}", want[d]) for d in prints}
    assert len(got) == len(prints)


def test_links_of_dense_groups(spark, monkeypatch):
    """Hot keys in blocks: chains and balls of close fingerprints."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    r = random.Random(5)
    prints = set()
    for _ in range(4):
        x = r.getrandbits(64)
        for _ in range(60):
            prints.add(x)
            x ^= 1 << r.randrange(64)
            if r.random() < 0.5:
                x ^= 1 << r.randrange(64)
        prints |= {x ^ (1 << i) ^ (1 << r.randrange(64)) for i in range(64)}
    prints = sorted(prints)
    signed = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    df = spark.createDataFrame(signed, "fp long")
    edges = [(int(np.int64(a).view(np.uint64)), int(np.int64(b).view(np.uint64)))
             for a, b in simhash.links(df).distinct().collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges) and len(edges) < 40 * len(prints)
    want = brute_components({p: p for p in prints})
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {p: find(p) for p in prints} == want


def test_simhash_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = simhash.simhash_groups(odd_docs).collect()
    assert len(got) == len(odd_rows)
    prints = {i: brute_fingerprint(t) for i, t, *_ in odd_rows if i is not None}
    nameless = {10**9 + k: brute_fingerprint(t) for k, (i, t, *_) in enumerate(odd_rows) if i is None}
    want = brute_components({**prints, **nameless})
    want = {i: want[i] for i in prints}
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        if r.doc_id is not None:
            assert int(r.fingerprint, 16) == prints[r.doc_id]
    assert simhash.simhash_groups(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs, simhash.simhash_groups(odd_docs))
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 2


def test_rows_without_doc_id_link_others(spark, monkeypatch):
    """A chain of 3-bit links over a row without doc_id is one component."""
    made = [(1, 0), (None, 7), (2, 63), (3, 63), (None, 0xFF << 40), (4, (0xFF << 40) | (1 << 50)), (5, 0xFFFF << 12)]
    df = spark.createDataFrame(made, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: df)
    got = simhash.simhash_groups(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]


# --- lines -----------------------------------------------------------------

def brute_lines(docs):
    """{doc: removed line numbers}: similarity to any earlier line."""
    earlier, out = [], {}
    for doc, text in sorted(docs, key=lambda r: r[0]):
        gone = []
        for n, line in enumerate((text or "").split("\n")):
            w = {x for x in line.lower().replace("\t", " ").replace("\r", " ").split(" ") if x}
            if not w:
                continue
            if any(5 * len(w & e) >= 4 * len(w | e) for e in earlier):
                gone.append(n)
            earlier.append(w)
        out[doc] = gone
    return out


def line_texts(seed, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    pool = [[r.choice(words) for _ in range(r.randint(1, 25))] for _ in range(30)]
    docs = []
    for i in range(n):
        out = []
        for _ in range(r.randint(0, 6)):
            line = list(r.choice(pool)) if r.random() < 0.7 else [r.choice(words) for _ in range(r.randint(0, 12))]
            for _ in range(r.randint(0, 3)):
                if line:
                    line[r.randrange(len(line))] = r.choice(words)
            out.append((" " if r.random() < 0.8 else "\t").join(line).upper() if r.random() < 0.2 else " ".join(line))
        docs.append((i, "\n".join(out)))
    return docs + [(n + 1, None), (n + 2, "")]


def test_lines_equal_brute_force(spark):
    for seed in (1, 2):
        docs = line_texts(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        got = lines.line_report(df).collect()
        want = brute_lines(docs)
        assert {r.doc_id: list(r.removed_lines) for r in got} == want
        assert all(r.n_removed == len(want[r.doc_id]) for r in got) and sum(r.n_removed for r in got) > 30


def test_near_copies_are_not_paired_all_with_all(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(base[:k] + [f"new{i}"] + base[k + 1:])) for i in range(400) for k in [r.randrange(30)]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    d = lines._identified(df, "doc_id", "text")
    reps = lines._coded(d, 4, 5).select("doc", "line", "size", "sig", "wide", "skip", "prefix")
    pairs = lines._candidates(lines._prefix_rows(reps), 4, 5).count()
    assert pairs < 400 * 25 < 400 * 399 / 2
    got = {r.doc_id: list(r.removed_lines) for r in lines.line_report(df).collect()}
    assert got == brute_lines(docs)


def test_pairs_of_a_crowd_grow_with_its_lines(spark, monkeypatch):
    """Copies of which few pairs are similar enough, so that neighbours seldom are."""
    r = random.Random(4)
    base, docs = [f"w{i}" for i in range(40)], []
    for i in range(600):
        gone = set(r.sample(range(40), r.choice((1, 2, 2, 3, 3, 4, 4, 4, 5, 5, 6, 6))))
        docs.append((i, " ".join(f"new{i}x{k}" if k in gone else w for k, w in enumerate(base))))
    seen, verified = [], lines._verified
    monkeypatch.setattr(lines, "_verified", lambda d, pairs, *a: seen.append(pairs.count()) or verified(d, pairs, *a))
    got = {x.doc_id: list(x.removed_lines) for x in lines.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs) and sum(map(len, got.values())) > 300
    assert sum(seen) < 600 * 10, seen


def test_lines_ship_no_large_literals(spark):
    """The table of classes (1 MB) and the filter of documents (128 KB) are not
    spelt out in plans, which the driver describes again and again."""
    df = spark.createDataFrame([(i, f"alpha beta w{i}\n \t\nx y z") for i in range(20)], "doc_id long, text string")
    d = lines._identified(df, "doc_id", "text")
    coded = lines._coded(d, 4, 5)
    assert coded.count() == 40
    only = lines._only(d, d.filter("doc % 2 = 0").select("doc"))
    assert {r.doc for r in only.collect()} >= set(range(0, 20, 2))
    for x in (coded, only):
        assert len(x._jdf.queryExecution().toString()) < 100_000


def test_lines_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = lines.line_report(odd_docs).collect()
    assert len(got) == len(odd_rows)
    loose = [(-2 + k, t) for k, (i, t, *_) in enumerate(x for x in odd_rows if x[0] is None)]
    want = brute_lines(loose + list({i: t for i, t, *_ in odd_rows if i is not None}.items()))
    assert {r.doc_id: list(r.removed_lines) for r in got if r.doc_id is not None} == {k: v for k, v in want.items() if k > 0}
    assert lines.line_report(no_docs).count() == 0
    kept = lines.dedup_lines(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(odd_rows)
    text = {r.doc_id: r.text for r in kept.collect()}
    assert text[2] is None and text[3] == "" and text[7] == "\n\n \n"
    for i, t, *_ in odd_rows:
        if i is not None and t:
            assert text[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i])
    assert lines.dedup_lines(no_docs).count() == 0
