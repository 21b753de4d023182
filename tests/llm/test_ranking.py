"""Exact dedup, ranked search and whitening."""
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_helpers import extra

from murmur.llm import exact, lexical, whiten
from murmur.llm import queries as Q


# ------------------------------------------------------------------ exact dedup

def norm(text):
    return re.sub("[ \t\n\x0b\x0c\r]", "", text or "")


def brute_groups(rows):
    """Rows (doc_id, text) to the multiset of (doc_id, keep_id, size, kept, sha)."""
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for k, members in groups.items():
        members.sort(key=lambda m: m[:3])
        sha = hashlib.sha256(k.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), at == 0, sha) for at, m in enumerate(members)]
    return sorted(map(str, out))


def got_groups(df):
    return sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in df.collect())


def texts_with_copies(seed, n=600):
    r = random.Random(seed)
    base = ["".join(r.choice("ab漢é😀 ") for _ in range(r.randint(0, 12))) for _ in range(n // 3)]
    out = []
    for i in range(n):
        t = r.choice(base) if i % 3 else base[0]
        if r.random() < 0.5:
            t = "".join(c + r.choice(["", "", " ", "\n", "\t\r", "\x0b\x0c"]) for c in t)
        out.append((i, t))
    return out


@pytest.mark.parametrize("key_bits,most_words", [(16, 1 << 22), (1, 1 << 22), (4096, 1 << 13)])
def test_exact_groups_equal_brute_force(spark, key_bits, most_words):
    """As usual, with a filter full of false hits, and with several parts."""
    rows = texts_with_copies(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got_groups(exact.exact_groups(df, key_bits=key_bits, most_words=most_words)) == brute_groups(rows)


def test_filter_passes_unique_rows_and_keeps_every_copy(spark):
    rows = [(i, f"text number {i}") for i in range(4000)] + [(5000 + i, f"text  number {i}") for i in range(0, 4000, 40)]
    marks = exact.split_repeated(exact.digests(spark.createDataFrame(rows, "doc_id long, text string")))
    maybe = {r.doc_id for r in marks.filter("maybe").collect()}
    assert {r[0] for r in rows if r[0] >= 5000 or r[0] % 40 == 0} <= maybe
    assert len(maybe) <= 200 + 40    # half a per cent or so of the unique ones
    assert exact.plan_filter(10, 16)[0] == 1 and exact.plan_filter(10 ** 10, 16)[0] == 597


def test_exact_groups_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    assert got_groups(exact.exact_groups(odd_docs)) == brute_groups([(r[0], r[1]) for r in odd_rows])
    assert exact.exact_groups(no_docs).count() == 0 and exact.keep_one(no_docs).count() == 0
    kept = exact.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert len(kept.collect()) == len({norm(r[1]) for r in odd_rows})


def test_keep_one_carries_rows_through(spark):
    rows = texts_with_copies(8, 300) + [(7, "same id"), (7, "same\nid"), (None, "no id"), (None, "no  id")]
    df = extra(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = {norm(r.text): (r.doc_id, len(r.text), r.size) for r in exact.keep_one(df).collect()}
    want = {}
    for i, t in rows:
        want[norm(t)] = min(want.get(norm(t), (0, True, 0, None)), (-len(t), i is None, i or 0, i))
    assert got == {k: (v[3], -v[0], 1) for k, v in want.items()}


def test_hot_group_is_reduced_in_pieces(spark):
    """A text in a third of the rows becomes at most SALTS rows of one key each."""
    df = spark.range(30_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'the same', concat('text ', id)) AS text")
    rows = exact.split_repeated(exact.digests(df)).filter("maybe")
    pieces = exact.groups_of(rows.selectExpr("*", f"cast(pmod(xxhash64(uid), {exact.SALTS}) as int) AS salt"))
    assert pieces.filter("group_size = 10000").count() > exact.SALTS // 2
    assert exact.exact_groups(df).filter("kept").count() == 20_001


# ---------------------------------------------------------------- ranked search

def brute_terms(text):
    t = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t)


def brute_search(docs, items, top=10):
    held = [(i, Counter(brute_terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(brute_terms(t))
    out = []
    for item, terms in asked.items():
        rows = []
        for i, c, n in held:
            m = 10 + 90 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in terms if t in c)
            if s > 0:
                rows.append((-s, i is None, i or 0, i, sum(t in c for t in terms)))
        out += [(item, k + 1, r[3], -r[0], r[4]) for k, r in enumerate(sorted(rows, key=lambda r: r[:3])[:top])]
    return sorted(out, key=str)


def got_search(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score, r.n_matched) for r in df.collect()), key=str)


def search_case(seed, n=400, vocabulary=60):
    r = random.Random(seed)
    words = ["é", "漢字", "A1", "b", "Zz", "😀"] + [f"w{k}" for k in range(vocabulary)]
    pick = lambda k: "".join(r.choice(words[: max(2, int(len(words) * r.random() ** 2))]) + r.choice([" ", "-", "\n", "'"]) for _ in range(k))
    docs = [(i, pick(r.randint(0, 40))) for i in range(n)]
    docs += [(n + i, docs[i][1]) for i in range(30)]    # equal scores
    return docs, [(i, pick(r.randint(0, 90))) for i in range(25)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_ranked_search_equals_brute_force(spark, block_bytes, monkeypatch):
    docs, items = search_case(5)
    monkeypatch.setattr(lexical, "EVALUATE", 3)
    got = lexical.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                                spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert got_search(got) == brute_search(docs, items)


def test_masks_over_64_terms_and_late_stop():
    """Wide masks; a block's best is found although few documents are scored."""
    r = random.Random(2)
    sets = [sorted(r.sample(range(200), r.randint(1, 150))) for _ in range(3000)]
    m = np.full(3000, 100)
    post = lexical._Postings(np.concatenate(sets), np.ones(sum(map(len, sets)), dtype=np.int64),
                             np.array(list(map(len, sets))), m, np.arange(1, 201))
    bits, docs, start = post.masks(list(range(200)))
    for k, at in enumerate(start):
        assert np.flatnonzero(bits[k]).tolist() == sets[docs[at]]
    assert len(docs) == 3000
    scored = []
    keep = post.scores
    post.scores = lambda terms, some: (scored.append(len(some)), keep(terms, some))[1]
    best = lexical.best_of_block(post, list(range(200)), np.arange(3000), np.zeros((0, 3), dtype=np.int64), 10)
    want = sorted(((sum(t + 1 for t in s), -i) for i, s in enumerate(sets)), reverse=True)[:10]
    assert best[:, 1].tolist() == [-i for _, i in want] and sum(scored) < 300


def test_ranked_search_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    items = [(1, "same line here"), (1, "word1 and"), (2, None), (3, ""), (4, "!?"), (None, "word2"), (5, "漢字 w5x5 TEXT"),
             (6, " ".join(f"w{i}x{i % 31}" for i in range(977)))]
    df = extra(spark.createDataFrame(items, "item_id long, text string"))
    assert got_search(lexical.ranked_search(odd_docs, df)) == brute_search([(r[0], r[1]) for r in odd_rows], items)
    assert lexical.ranked_search(no_docs, df).count() == 0
    assert lexical.ranked_search(odd_docs, df.limit(0)).count() == 0


# -------------------------------------------------------------------- whitening

def spectra():
    r = np.random.default_rng(4)
    q, _ = np.linalg.qr(r.normal(size=(30, 30)))
    yield r.normal(size=(500, 64))
    yield r.normal(size=(300, 40)) * np.logspace(0, -9, 40)
    yield q @ np.diag([3.0] * 4 + [1.0] * 26) @ q.T
    yield q @ np.diag([3, 3, 3 - 1e-10] + [1] * 27) @ q.T
    yield np.diag([5.0, 5, 5, 1, 1, 0, 0])
    yield np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    yield np.zeros((5, 5))
    yield r.normal(size=(9, 1))


def test_qd_solver_against_svd():
    for a in spectra():
        d = a.shape[1]
        rr = np.linalg.qr(a, mode="r")
        values, z = whiten.leading_vectors(rr, 4)
        want = np.linalg.svd(a, compute_uv=False) ** 2
        top = max(want[0], 1e-300)
        assert np.abs(values - want).max() <= 1e-13 * top
        assert np.abs(z.T @ z - np.eye(z.shape[1])).max() < 1e-12
        for k in range(min(4, d)):
            assert np.linalg.norm(rr.T @ (rr @ z[:, k]) - values[k] * z[:, k]) <= 1e-13 * top


def test_dqds_keeps_small_values_to_relative_accuracy():
    """A graded bidiagonal matrix whose singular values are known from its exact inverse."""
    from fractions import Fraction
    diag, upper = np.array([1.0, 1e-4, 1e-9]), np.array([1.0, 1e-4])
    values = whiten.dqds(diag, upper)
    assert abs(math.prod(values.tolist()) / float(Fraction(1) * Fraction(1e-4) ** 2 * Fraction(1e-9) ** 2) - 1) < 1e-13
    assert abs(values.sum() / float((diag ** 2).sum() + (upper ** 2).sum()) - 1) < 1e-14


def brute_whitened(rows):
    whole = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    d = Counter(len(v) for _, v in whole)
    d = max(d, key=lambda k: (d[k], k))
    x = [(i, [math.floor(256 * np.float64(np.float32(c))) for c in v]) for i, v in whole if len(v) == d]
    fit = np.array(sorted({tuple(v) for _, v in x}))
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, z = np.linalg.eigh(c.T @ c / n)
    return x, n, s.tolist(), e[::-1], z[:, ::-1]


def check_whitened(rows, got, tolerance=1e-9):
    x, n, s, e, z = brute_whitened(rows)
    k = min(4, len(e))
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), j + 1) for i, _ in x for j in range(k))
    off = {}
    for i, v in x:
        off.setdefault(str(i), []).append((sum((n * a - b) ** 2 for a, b in zip(v, s)), (np.array(v) - np.array(s) / n) @ z[:, :k] / np.sqrt(e[:k])))
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        c = r.component - 1
        match = [w for d, w in off[str(r.vec_id)] if d == r.deviation]
        assert match and r.n == n and r.identity_error < 1e-9
        assert abs(r.explained - e[c] / e.sum()) <= 1e-10
        sign.setdefault(c, 1 if r.whitened * match[0][c] >= 0 else -1)
        assert min(abs(sign[c] * r.whitened - w[c]) for w in match) < tolerance


def test_whitening_equals_eigendecomposition(spark):
    r = np.random.default_rng(6)
    rows = [(i, (r.normal(size=12) * np.linspace(3, 0.3, 12)).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(3, rows[3][1])]
    df = extra(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(40))
    check_whitened(rows, whiten.whitened(df).collect())


def test_whitening_over_the_table(spark, sf_small):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    check_whitened(rows, Q.QUERIES["op11_whitening"](spark, sf_small).collect())


def test_whitening_of_odd_rows(spark):
    r = np.random.default_rng(7)
    good = [(i, r.normal(size=3).tolist()) for i in range(40)]
    rows = good + [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 0.0]), (104, [float("inf"), 0.0, 0.0]),
                   (105, [1.0, 2.0]), (None, [0.5, -0.25, 1.0]), (0, good[0][1]), (0, good[0][1])]
    schema = "vec_id long, embedding array<float>"
    check_whitened(rows, whiten.whitened(extra(spark.createDataFrame(rows, schema))).collect())
    none = whiten.whitened(spark.createDataFrame(rows[40:45], schema))
    assert none.count() == 0 and "identity_error" in none.columns
    assert whiten.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0    # nothing varies
    line = whiten.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], schema)).collect()
    assert len(line) == 5 and all(abs(x.explained - 1) < 1e-12 and x.component == 1 for x in line)


def test_deviation_is_exact_or_null():
    x = np.array([[2 ** 40, 0], [3, 4]], dtype=np.int64)
    assert whiten._exact_deviation(x, 10 ** 6, [0, 0]) == [None, 25 * 10 ** 12]
    big = np.array([[2 ** 31, 1]], dtype=np.int64)
    assert whiten._exact_deviation(big, 1, [1, 0]) == [(2 ** 31 - 1) ** 2 + 1]
