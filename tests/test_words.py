"""Word lists of any size: the automaton against substring tests."""
import random

import pytest
from pyspark.sql import functions as F

from murmur.operators import alerts as AL
from murmur.operators import words as W
from murmur.streaming import streams as ST


def brute(texts, words):
    return {(i, w) for i, t in enumerate(texts) for w in words if w in (t or "")}


def test_automaton_equals_substring_search():
    r = random.Random(1)
    for _ in range(150):
        letters = "abé漢😀"[: r.randint(1, 5)]
        words = sorted({"".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 30))})
        texts = ["".join(r.choice(letters + " x") for _ in range(r.randint(0, 700))) for _ in range(r.randint(1, 8))]
        row, word = W.Automaton([w.encode() for w in words]).found([t.encode() for t in texts])
        assert {(i, words[k]) for i, k in zip(row.tolist(), word.tolist())} == brute(texts, words)
        assert len(row) == len(brute(texts, words))


def test_match_longer_than_a_stretch():
    long = "abcdefghij" * 200
    texts = [("x" * 1000 + long + "y").encode(), long[:-1].encode(), (long[1:] + "a").encode()]
    row, word = W.Automaton([long.encode(), b"jx", b"ja"]).found(texts)
    assert list(zip(row.tolist(), word.tolist())) == [(0, 0), (0, 2), (1, 2), (2, 2)]


def made(spark, seed=5):
    r = random.Random(seed)
    words = [(r.randint(0, 40), "".join(r.choice("abcé") for _ in range(r.randint(1, 7)))) for _ in range(300)]
    words += [(3, ""), (4, "  "), (5, None), (words[0][0] + 1, words[0][1])]
    texts = [(i, "".join(r.choice("abcéd ") for _ in range(r.randint(0, 60))), f"k{i}") for i in range(200)] + [(300, None, "n"), (301, "", None)]
    return words, texts, spark.createDataFrame(words, "pos long, word string"), spark.createDataFrame(texts, "id long, content string, kept string").repartition(3)


@pytest.mark.parametrize("most_states", [W.MOST_STATES, 100])
def test_matches_over_groups_of_words(spark, most_states):
    words, texts, wdf, tdf = made(spark)
    place = {}
    for p, w in words:
        if w and w.strip():
            place[w] = min(place.get(w, p), p)
    assert (len(list(W.word_groups(wdf, most_states))) > 3) == (most_states == 100)
    got = {(r.id, r.kept, r.pos, r.word) for r in W.word_matches(tdf, wdf, "content", most_states).collect()}
    assert got == {(i, k, place[w], w) for i, t, k in texts for w in place if w in (t or "")}
    first = {}
    for i, _, p, w in got:
        first[i] = min(first.get(i, (p, w)), (p, w))
    rows = W.first_words(tdf, wdf, "id", "content", most_states).collect()
    assert {r.id: (r.pos, r.word) for r in rows} == first and len(rows) == len(first)
    assert all(r.kept == f"k{r.id}" for r in rows)


def test_groups_keep_within_the_size(spark):
    _, _, wdf, _ = made(spark)
    for group in W.word_groups(wdf, 100):
        assert len(W.Automaton([w.encode() for _, w in group]).first) <= 100 + max(len(w.encode()) for _, w in group)


def test_no_words_and_no_texts(spark):
    _, _, wdf, tdf = made(spark)
    assert W.word_matches(tdf, wdf.limit(0), "content").count() == 0
    none = W.first_words(tdf.limit(0), wdf, "id", "content")
    assert none.count() == 0 and none.columns == ["id", "kept", "pos", "word"]


def test_rules_with_long_lists_equal_the_short_path(spark, monkeypatch):
    """L2 and J2 give the same whether a list is tested word by word or by automaton."""
    import datetime as dt
    now = dt.datetime(2024, 1, 1, 12)
    posts = spark.createDataFrame([(i, "weibo" if i % 2 else "xiaohongshu", f"text {i} of Word{i % 7} and w{i % 5}" * 9, now) for i in range(60)],
                                  "id long, platform string, content string, crawl_time timestamp_ntz")
    rules = spark.createDataFrame([(1, 1, ["w3", "Word2", "zz"]), (2, 2, ["Word2", "w3", " ", "text 1"])],
                                  "rule_id long, silence_hours int, words array<string>")
    keywords = spark.createDataFrame([("WORD3", "all", True), ("w1", "weibo", True)], "keyword string, platform string, enabled boolean")

    def answers():
        return (sorted(map(str, AL.keyword_candidates(posts, rules, now).drop("created_at").collect())),
                sorted(map(tuple, AL.monitored_posts(posts, keywords).collect())))

    short = answers()
    monkeypatch.setattr(AL, "FEW_WORDS", 1)
    assert answers() == short and short[0] and short[1]


def test_word_list_of_the_posts_is_long(spark):
    """The registered queries use lists far beyond what a rule lists by hand."""
    from murmur.plans import catalog
    assert catalog._word_list(spark, "/root/testdata/sf0.01").filter(F.length("word") >= 2).count() > 10_000


def test_texts_are_computed_once_however_many_automata(spark):
    from pyspark.sql import functions as F
    from murmur.operators import words as W
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def say(k):
        seen.add(1)
        return f"word{k} and nothing"

    texts = spark.range(20).select("id", say("id").alias("content"))
    listed = spark.createDataFrame([(k, f"{'abcdefgh'[k % 8]}word{k}"[k < 20:]) for k in range(40)], "pos long, word string")
    assert len(list(W.word_groups(listed, 30))) > 3
    assert W.word_matches(texts, listed, "content", 30).count() == 30       # word1 is in word10 to word19, too
    assert seen.value == 20
    firsts = W.first_words(texts, listed, "id", "content", 30)
    assert {r.id: r.word for r in firsts.collect()} == {k: f"word{1 if 9 < k else k}" for k in range(20)}
    assert seen.value == 40


def test_batches_without_recent_posts_build_no_automaton(spark, tmp_path, monkeypatch):
    """Three deliveries, one of them recent: the word list becomes an automaton once."""
    import datetime as dt
    now = dt.datetime(2024, 1, 30, 12)
    for k, day in enumerate((1, 30, 2)):
        (spark.createDataFrame([(k, "a planted word", now.replace(day=day, hour=11))], "id long, content string, crawl_time timestamp_ntz")
         .coalesce(1).write.parquet(f"{tmp_path}/in/part{k}"))
    posts = (spark.readStream.schema("id long, content string, crawl_time timestamp_ntz").option("recursiveFileLookup", "true")
             .option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    words = spark.createDataFrame([(0, "planted"), (1, "none")], "pos long, word string")
    built = []
    monkeypatch.setattr(W, "Automaton", lambda words, real=W.Automaton: built.append(words) or real(words))
    out = ST.run_keyword_alerts(posts, words, 24 * 60, now)
    assert [(r.id, r.matched_word) for r in spark.read.parquet(out).collect()] == [(1, "planted")]
    assert len(built) == 1 and len(ST._epochs(spark, out)) == 3


def test_table_of_words_equals_substring_search(monkeypatch):
    """Runs that repeat, words of one hash, words with blanks and across runs."""
    import pyarrow as pa
    r = random.Random(2)
    monkeypatch.setattr(W, "PAIRS", 7)
    for k in range(150):
        letters = "abé漢😀 "[: r.randint(1, 6)]
        words = sorted({"".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 30))})
        texts = ["".join(r.choice(letters + " x") for _ in range(r.randint(0, 300))) for _ in range(r.randint(1, 8))]
        monkeypatch.setattr(W.WordTable, "BASE", 1 if k % 3 == 0 else 0xD1342543DE82EF95)      # 1: anagrams share a hash
        table = W.WordTable(pa.array([w.encode() for w in words]))
        row, word = table.found([t.encode() for t in texts])
        want = brute(texts, words)
        assert {(i, words[k]) for i, k in zip(row.tolist(), word.tolist())} == want and len(row) == len(want)
        row, word = table.found([t.encode() for t in texts], True)
        assert dict(zip(row.tolist(), word.tolist())) == {i: min(words.index(w) for j, w in want if j == i) for i, _ in want}


@pytest.mark.parametrize("most_words", [50, W.MOST_STATES])
def test_long_lists_take_a_pass_per_table_not_per_automaton(spark, monkeypatch, most_words):
    """Lists of any number of automata: as many passes as tables, no automaton built."""
    words, texts, wdf, tdf = made(spark)
    monkeypatch.setattr(W, "MOST_WORDS", most_words)
    monkeypatch.setattr(W, "Automaton", None)
    passes = []
    monkeypatch.setattr(W, "table_matches", lambda *a, real=W.table_matches: passes.append(a[1].num_rows) or real(*a))
    place = {w: min(p for p, x in words if x == w) for _, w in words if w and w.strip()}
    got = {(r.id, r.word) for r in W.word_matches(tdf, wdf, "content", 100).collect()}
    assert got == {(i, w) for i, t, _ in texts for w in place if w in (t or "")}
    assert len(passes) == -(-len(place) // most_words) and sum(passes) == len(place)
    firsts = {r.id: (r.pos, r.word) for r in W.first_words(tdf, wdf, "id", "content", 100).collect()}
    assert firsts == {i: min((place[w], w) for j, w in got if j == i) for i, _ in got}
