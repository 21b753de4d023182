"""Quality rules, decontamination and the pipeline."""
import random
import re
from collections import Counter

from murmur.llm import decontaminate, quality
from test_dedup import brute_components, brute_fingerprint, brute_lines


def brute_quality(text):
    text = text or ""
    w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", text) if x]
    n = len(w)

    def marked(k):
        seen = Counter(tuple(w[i:i + k]) for i in range(n - k + 1))
        return {j for i in range(n - k + 1) if seen[tuple(w[i:i + k])] > 1 for j in range(i, i + k)}

    rows = [x for x in text.split("\n") if re.sub("[ \t\n\x0b\x0c\r]", "", x)]
    repeat = len(marked(3))
    failed = n < 50 or 100 * repeat > 50 * n
    longest = len(marked(max(10, min(200, n // 10) + 1))) > 0
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": len(rows) - len(set(rows)), "n_repeat_words": repeat, "base_failed": failed,
            "kept": not failed and 100 * len(marked(10)) <= 20 * n and not longest}


def made_texts(seed, n=80):
    r = random.Random(seed)
    words = ["a", "é", "b#", "|", "漢", "word", "of"] + [f"x{i}" for i in range(300)]
    out = []
    for _ in range(n):
        t = [r.choice(words) for _ in range(r.randint(0, 120))]
        if r.random() < 0.6 and len(t) > 20:
            p = r.randrange(len(t) - 15)
            t += t[p:p + r.randint(3, 60)] * r.randint(1, 2)
        out.append("".join(x + r.choice([" ", " ", "\n", "\t "]) for x in t))
    out.append(" ".join(f"u{i}" for i in range(1000)) + " " + " ".join(f"u{i}" for i in range(250)))    # one repeat of 250 words
    return out


def test_quality_equals_brute_force(spark):
    texts = made_texts(4)
    rows = quality.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_quality(texts[r.doc_id])
        assert {k: r[k] for k in want} == want
    assert {(r.base_failed, r.kept) for r in rows} == {(True, False), (False, True), (False, False)}


def test_each_repetition_limit_rejects_alone(spark):
    """Texts that pass the base rule and all limits but one."""
    w = [f"u{i}" for i in range(6000)]
    texts = {"clean": w[:400], "covered": w[:264] + w[:12] + w[100:112] + w[200:212],
             "longest percent": w[:264] + w[252:264] * 3, "longest": w + w[:210], "short repeat": w[:60] + w[:9]}
    rows = quality.quality(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts.values())], "doc_id long, text string"))
    got = {list(texts)[r.doc_id]: r for r in rows.collect()}
    assert not any(r.base_failed for r in got.values())
    assert {k for k, r in got.items() if r.kept} == {"clean", "short repeat"}
    over = {k: (100 * r.covered_words > 20 * r.n_words, 100 * r.longest_repeat > 10 * r.n_words, r.longest_repeat > 200)
            for k, r in got.items() if not r.kept}
    assert over == {"covered": (True, False, False), "longest percent": (False, True, False), "longest": (False, False, True)}


def test_quality_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = quality.quality(odd_docs).collect()
    want = sorted(str((i, *brute_quality(t).values())) for i, t, *_ in odd_rows)
    names = list(brute_quality(""))
    assert sorted(str((r.doc_id, *[r[k] for k in names])) for r in got) == want
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(brute_quality(t)["kept"] for _, t, *_ in odd_rows)
    assert quality.quality(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_contaminated(docs, items):
    out = []
    for d, text in docs:
        own = shingles(text)
        for i, item in items:
            s = shingles(item)
            if s and 10 * len(s & own) >= 8 * len(s):
                out.append((d, i, len(s), len(s & own)))
    return sorted(out, key=str)


def run_contaminated(spark, docs, items):
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                                     spark.createDataFrame(items, "item_id long, text string"))
    return sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got.collect()), key=str)


def made_leaks(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    line = lambda n: [r.choice(words) for _ in range(n)]      # noqa: E731
    items = [(i, " ".join(line(r.choice([0, 1, 3, 5, 6, 9, 30])))) for i in range(40)] + [(99, None), (None, " ".join(line(12)))]
    docs = []
    for d in range(60):
        t = line(r.randint(0, 200))
        for _ in range(r.randint(0, 3)):
            x = (r.choice(items)[1] or "").split()
            if x and r.random() < 0.5:
                x[r.randrange(len(x))] = "changed"
            t += x
        docs.append((d, " ".join(t).title() if r.random() < 0.5 else "\n".join(t)))
    return docs + [(None, items[5][1]), (70, None), (70, None)], items


def test_decontamination_equals_brute_force(spark, monkeypatch):
    docs, items = made_leaks(6)
    want = brute_contaminated(docs, items)
    assert len(want) > 30
    assert run_contaminated(spark, docs, items) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)      # many blocks of items
    assert run_contaminated(spark, docs, items) == want


def test_decontamination_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    items = spark.createDataFrame([(1, odd_rows[0][1]), (2, ""), (3, None), (4, "a text without id a"), (5, "One")],
                                  "item_id long, text string")
    got = sorted(str((r.doc_id, r.item_id)) for r in decontaminate.contaminated(odd_docs, items).collect())
    want = brute_contaminated([r[:2] for r in odd_rows], [tuple(r) for r in items.collect()])
    assert got == sorted(str(x[:2]) for x in want) and want
    left = decontaminate.drop_contaminated(odd_docs, items)
    assert left.columns == odd_docs.columns
    bad = {x[0] for x in want}
    assert left.count() == sum(r[0] not in bad for r in odd_rows)
    assert decontaminate.contaminated(no_docs, items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(odd_docs, none).count() == 0
    assert decontaminate.drop_contaminated(odd_docs, none).count() == len(odd_rows)


def test_pipeline_equals_brute_force(spark, sf_small):
    import corpus_pipeline

    from murmur.llm.tokens import Encoder, default_tokenizer
    from test_tokens import check_packed

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    docs = {d: t for d, t in docs.items() if brute_quality(t)["kept"]}
    gone = brute_lines(list(docs.items()))
    docs = {d: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]) for d, t in docs.items()}
    comp = brute_components({d: brute_fingerprint(t) for d, t in docs.items()})
    docs = {d: t for d, t in docs.items() if comp[d] == d}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    bad = {x[0] for x in brute_contaminated(list(docs.items()), items)}
    docs = {d: t for d, t in docs.items() if d not in bad}
    rows = corpus_pipeline.run(spark, sf_small).collect()
    assert {r.doc_id for r in rows} == set(docs)
    check_packed(rows, docs, Encoder(default_tokenizer()))


def test_pipeline_stages_on_odd_rows(spark, odd_docs, no_docs, sf_small):
    import corpus_pipeline

    for docs in (odd_docs, no_docs):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_small)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
                assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            out.collect()


def test_pipeline_stages_decide_by_row(spark, tmp_path):
    """Rows without doc_id or with one that comes again: every text has its own decision."""
    import corpus_pipeline

    r = random.Random(3)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(60))      # noqa: E731
    item, one, two, three, four = text(), text(), text(), text(), text()
    rows = [(None, one), (None, item), (5, two), (5, "x " + item), (None, three), (None, three), (8, three), (9, four), (None, four)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    key = lambda d: sorted(map(tuple, d.collect()), key=str)      # noqa: E731
    assert key(corpus_pipeline.decontamination(spark, docs, str(tmp_path))) == sorted([x for x in rows if item not in x[1]], key=str)
    got = [x for x in rows if item not in x[1]]
    want = sorted([(None, one), (5, two), (8, three), (9, four)], key=str)
    assert key(corpus_pipeline.near_dedup(spark, spark.createDataFrame(got, "doc_id long, text string"), "")) == want

    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(5, f"{a}\n{b}"), (5, c), (5, f"{c} more\nown"), (6, f"{b}\nlast")]
    out = key(corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), ""))
    left = Counter(x for _, t in out for x in t.split("\n"))
    assert len(out) == 4 and {x: left[x] for x in (a, b, "own", "last")} == {a: 1, b: 1, "own": 1, "last": 1}
    assert left[c] + left[f"{c} more"] == 1
