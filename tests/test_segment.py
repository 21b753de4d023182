"""Dictionary segmentation (T1) against brute force."""
import itertools
import math
import random
from collections import Counter

import numpy as np

from murmur.operators import segment as SG


def cut_brute(run, cost, max_len):
    """The cheapest cut of a run by trying all of them (ties: longest last word, then the one before)."""
    best = None
    for k in range(len(run)):
        for at in itertools.combinations(range(1, len(run)), k):
            words = [run[a:b] for a, b in zip((0, *at), (*at, len(run)))]
            if any(len(w) > max_len or (w not in cost and len(w) > 1) for w in words):
                continue
            key = (sum(cost.get(w, SG.UNKNOWN) for w in words), [-len(w) for w in reversed(words)])
            if best is None or key < best[0]:
                best = (key, words)
    return best[1]


def test_paths_are_the_cheapest(spark):
    r = random.Random(3)
    words = {"".join(r.choice("ab漢") for _ in range(r.randint(1, 4))): r.randint(1, 50) for _ in range(25)}
    words.pop("b", None)    # a character that the dictionary lacks
    runs = list({"".join(r.choice("ab漢") for _ in range(r.randint(1, 9))) for _ in range(80)})
    costs = SG.word_costs(spark.createDataFrame(list(words.items()), "word string, freq long"))
    cost = {w.word: w.cost for w in costs.collect()}
    total = sum(words.values())
    assert all(abs(cost[w] - round(-math.log(n / total) * SG.UNIT)) <= 1 for w, n in words.items())
    got = {x.run: list(x.words) for x in SG.segment_runs(spark.createDataFrame([(x,) for x in runs], "run string"), costs).collect()}
    assert got == {x: cut_brute(x, cost, max(map(len, words))) for x in runs}


def test_paths_together_equal_paths_alone(spark, monkeypatch):
    r = random.Random(5)
    for _ in range(20):
        lengths = [r.choice([0, 1, 2, 5, 30]) for _ in range(r.randint(0, 60))]
        arcs = [(k, a, n, r.choice([0, 1, 2, 3 * SG.UNKNOWN])) for k, length in enumerate(lengths)
                for a in range(1, length + 1) for n in range(1, 5) if r.random() < 0.5]
        columns = [np.array([x[c] for x in arcs], dtype=np.int64) for c in range(4)]
        assert SG.best_paths(np.array(lengths, dtype=np.int64), *columns) == [
            SG.best_path(length, [x[1:] for x in arcs if x[0] == k]) for k, length in enumerate(lengths)]
    runs = spark.createDataFrame([("ab" * k + "c",) for k in range(200)] + [("",)], "run string").repartition(2)
    costs = SG.word_costs(spark.createDataFrame([("ab", 5), ("abab", 3), ("a", 1)], "word string, freq long"))
    want = {x.run: x.words for x in SG.segment_runs(runs, costs).collect()}      # together up to 256 characters, alone above
    assert "".join(want["ab" * 199 + "c"]) == "ab" * 199 + "c" and want[""] == [] and len(want) == 201
    monkeypatch.setattr(SG, "CELLS", 50)
    assert {x.run: x.words for x in SG.segment_runs(runs, costs).collect()} == want
    monkeypatch.setattr(SG, "TOGETHER", -1)
    assert {x.run: x.words for x in SG.segment_runs(runs, costs).collect()} == want


def learn_brute(runs, max_len, min_count, min_pmi, min_entropy):
    freq, near = Counter(), {}
    for run, n in runs.items():
        for a in range(len(run)):
            for b in range(a + 1, min(len(run), a + max_len) + 1):
                g = run[a:b]
                freq[g] += n
                near.setdefault((g, 0), Counter())[run[a - 1] if a else ""] += n
                near.setdefault((g, 1), Counter())[run[b:b + 1]] += n
    total = sum(n for g, n in freq.items() if len(g) == 1)
    h = {g: min(-sum(c / freq[g] * math.log(c / freq[g]) for c in near[g, s].values()) for s in (0, 1)) for g in freq}
    pmi = lambda g: min(math.log(freq[g] * total / freq[g[:k]] / freq[g[k:]]) for k in range(1, len(g)))
    return {g for g in freq if len(g) == 1 or (freq[g] >= min_count and h[g] >= min_entropy and pmi(g) >= min_pmi)}, freq


def test_dictionary_finds_planted_words(spark):
    """Runs made of a few words: the words are found, pieces and joins of them are not."""
    r = random.Random(1)
    planted = ["新能源", "人工智能", "就业", "股票", "天气", "ware"]
    runs = Counter("".join(r.choice([*planted, r.choice("甲乙丙丁戊己庚辛xyz")]) for _ in range(r.randint(2, 6))) for _ in range(600))
    df = spark.createDataFrame(list(runs.items()), "run string, n long")
    want, freq = learn_brute(runs, 6, 20, 1.0, 1.2)
    got = {x.word: x.freq for x in SG.learn_dictionary(df).collect()}
    assert got == {g: freq[g] for g in want}
    assert set(planted) <= set(got) and "人工智" not in got and "工智能" not in got and "业股" not in got


def test_tokens_by_given_dictionary(spark):
    posts = spark.createDataFrame([(1, "人工智能 is HERE，人工智能就业"), (2, None), (3, "的的 x9"), (4, "")], "id long, content string")
    given = spark.createDataFrame([("人工智能", 5), ("就业", 4), ("HERE", 2), ("is", 1), ("的的", 3), ("x9", 1), ("", 4)], "word string, freq long")
    got = sorted((x.id, x.term, x.tf) for x in SG.dictionary_tokens(posts, given, stop_words=["就业"]).collect())
    assert got == sorted([(1, "人工智能", 2), (1, "is", 1), (1, "here", 1), (3, "的的", 1), (3, "x9", 1)])
    assert SG.dictionary_tokens(posts.limit(0), given).count() == 0
    assert SG.dictionary_tokens(posts.limit(0)).count() == 0


def test_tokens_of_the_posts_equal_brute_force(spark, sf_small):
    from murmur.plans import catalog
    posts = catalog._D(spark, sf_small)
    own = {}
    for x in SG.post_runs(posts).collect():
        own.setdefault(x.run, []).append((x.id, x.n))
    words = {x.word: x.freq for x in SG.learn_dictionary(SG.run_counts(posts)).collect()}
    total = sum(words.values())
    cost = {w: round(-math.log(n / total) * SG.UNIT) for w, n in words.items()}
    want = Counter()
    for run, posts_of in own.items():
        arcs = [(a + 1, b - a, cost[run[a:b]]) for a in range(len(run)) for b in range(a + 1, min(len(run), a + SG.MAX_LEN) + 1) if run[a:b] in cost]
        ends = SG.best_path(len(run), arcs)
        for a, b in zip([0, *ends], ends):
            if b - a >= 2 and run[a:b] not in SG.STOP_WORDS_TOPIC:
                for i, n in posts_of:
                    want[i, run[a:b]] += n
    got = {(x.id, x.term): x.tf for x in catalog.QUERIES["tokens_dictionary"](spark, sf_small).collect()}
    assert got == dict(want) and len(got) > 2000


def test_very_long_run(spark):
    long = "ab" * 20_000 + "c"
    costs = SG.word_costs(spark.createDataFrame([("ab", 9), ("a", 1), ("b", 1)], "word string, freq long"))
    row = SG.segment_runs(spark.createDataFrame([(long,)], "run string"), costs).first()
    assert row.words == ["ab"] * 20_000 + ["c"]
