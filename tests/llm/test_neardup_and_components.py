import random

import pytest

from passagework.llm import neardup as nd
from passagework.llm.components import components
from passagework.llm.words import words

HOW = nd.Similar(700)
GROUPS = nd.Similar(700, 4, 32)


def sets(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(texts, n=3, least=20, t=0.7):
    s = {i: sets(x, n) for i, x in texts.items() if x and len(words(x)) >= least}
    return {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= t * len(s[a] | s[b])}


def edited(r, w, k):
    w = list(w)
    for _ in range(k):
        x, i = r.random(), r.randrange(len(w))
        if x < 0.4:
            w[i] = f"new{r.randrange(1000)}"
        elif x < 0.7:
            w.insert(i, f"ins{r.randrange(1000)}")
        else:
            w[i : i + 2] = reversed(w[i : i + 2])
    return w


def pairs(spark, texts, make, how):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "id long, body string, set_key string, n int")
    return {(r.id_a, r.id_b) for r in nd.record_pairs(*nd.similar_classes(df, make, how)).collect()}


def test_words_against_brute_force(spark):
    r = random.Random(4)
    base = [[f"w{r.randrange(300)}" for _ in range(r.choice([22, 40, 90, 400]))] for _ in range(60)]
    texts = {}
    for n in range(300):
        w = edited(r, r.choice(base), r.choice([0, 1, 2, 4, 8]))
        texts[n] = ("  ".join if n % 2 else " ".join)(x.upper() if n % 5 == 0 else x for x in w)
    want = brute(texts)
    assert len(want) > 200 and pairs(spark, texts, nd.word_shingles(3, 20), HOW) == want
    assert pairs(spark, texts, nd.word_shingles(3, 20), GROUPS) == want


def test_long_lists_are_salted_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(nd, "HOT", 8)
    monkeypatch.setattr(nd, "SAMPLE", 2)
    r = random.Random(7)
    base = [f"w{i}" for i in range(40)]
    texts = {n: " ".join(edited(r, base, r.choice([1, 2, 3]))) for n in range(120)}
    want = brute(texts)
    assert len(want) > 1000 and pairs(spark, texts, nd.word_shingles(3, 20), HOW) == want


def test_similar_sets_share_a_run():
    import numpy as np

    r = np.random.default_rng(3)
    missed = met = 0
    for _ in range(30_000):
        n = int(r.choice([3, 5, 7, 12, 13, 18, 30, 41, 57, 64, 120, 400]))
        common = -(-7 * n // 10)
        a, b = (r.integers(-(1 << 63), 1 << 63, k) for k in ((n - common) // 2, n - common - (n - common) // 2))
        both = r.integers(-(1 << 63), 1 << 63, common)
        x, y = (np.sort(np.concatenate([both, z])) for z in (a, b))  # at the threshold, or just over it
        met += 1
        missed += not len(np.intersect1d(nd.run_keys(x, 700), nd.run_keys(y, 700)))
    assert missed <= met * 3e-4, (missed, met)


def test_titles_against_brute_force(spark):
    r = random.Random(5)
    base = [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(4, 11))) for _ in range(4)) for _ in range(80)]
    texts = {}
    for n in range(250):
        s = list(r.choice(base))
        for _ in range(r.choice([0, 1, 2])):
            i = r.randrange(len(s) - 1)
            s[i], s[i + 1] = s[i + 1], s[i]
        texts[n] = "".join(s)
    norm = {i: " ".join(words(t)) for i, t in texts.items()}
    g = {i: {t[k : k + 3] for k in range(len(t) - 2)} for i, t in norm.items() if len(t) >= 15}
    want = {(a, b) for a in g for b in g if a < b and len(g[a] & g[b]) * 10 >= 7 * len(g[a] | g[b])}
    assert pairs(spark, texts, nd.char_shingles(3, 15), nd.Similar(700, 5, 48)) == want


def test_dirt(spark):
    long = " ".join(f"a{i}" for i in range(5000))
    texts = {1: None, 2: "", 3: "too short", 4: long, 5: long + " end", 6: long, 7: "same " * 30, 8: "same " * 25}
    assert pairs(spark, texts, nd.word_shingles(3, 20), HOW) == {(4, 5), (4, 6), (5, 6), (7, 8)}
    assert pairs(spark, {}, nd.word_shingles(3, 20), HOW) == set()


def test_repeated_ids_count_once(spark):
    t = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "id long, body string")
    assert [(r.id_a, r.id_b) for r in nd.record_pairs(*nd.similar_classes(df, nd.word_shingles(3, 20), HOW)).collect()] == [(1, 2)]


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {q.id: q.component for q in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [1, 3, 8, 50])
def test_parity_never_exceeds_the_difference(n):
    import numpy as np

    r = np.random.default_rng(n)
    a, b = (np.unique(r.integers(0, 1 << 63, 40).astype(np.uint64)) for _ in range(2))
    b = np.unique(np.concatenate([a[n:], b[:n]]))
    bits = lambda h: [int(x) & (2**64 - 1) for x in nd.parity(h)]
    differ = sum((x ^ y).bit_count() for x, y in zip(bits(a), bits(b)))
    assert differ <= len(set(a.tolist()) ^ set(b.tolist()))
