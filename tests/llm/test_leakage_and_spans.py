import random

from passagework.llm import leakage as lk
from passagework.llm import spans as sp
from passagework.llm.words import words

CASE = "case_id string, question string, passage string, doc_id string"


def cases(spark, *rows):
    return spark.createDataFrame([(*r, "x") for r in rows], CASE)


def docs(spark, *rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, case_id string")


def text(r, n, vocabulary=60):
    return " ".join("w" + "abcdefghij"[k // 500 % 10] + "abcdefghij"[k // 50 % 10] + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"[k % 50].lower() * (1 + k % 50 // 26) for k in (r.randrange(vocabulary) for _ in range(n)))


def test_verbatim_against_brute_force(spark):
    r = random.Random(1)
    cs = [(f"c{i}", text(r, 20), text(r, 60)) for i in range(20)]
    ds = []
    for i in range(120):
        t = text(r, 80)
        if i % 3 == 0:
            w = r.choice(cs)[r.choice([1, 2])].split()
            k, n = r.randrange(0, 8), r.choice([11, 12, 13, 14, 30])
            t = t[:100] + " " + " ".join(w[k : k + n]).upper() + ", " + t[100:]
        ds.append((i, t))
    runs = lambda t: {tuple(w[k : k + 13]) for w in [words(t)] for k in range(len(w) - 12)}
    want = {(c, d) for c, q, p in cs for d, t in ds if (runs(q) | runs(p)) & runs(t)}
    got = {(x.case_id, x.doc_id) for x in lk.verbatim_leaks(docs(spark, *ds), cases(spark, *cs)).collect()}
    assert got == want and len(want) > 10


def test_both_ways_of_joining_agree(spark):
    r = random.Random(2)
    c = cases(spark, ("a", text(r, 30), None))
    d = docs(spark, (1, text(r, 10) + " " + c.first().question), (2, text(r, 50)))
    sent, shuffled = (lk.template_matches(d, c, max_broadcast=m) for m in (1 << 20, 0))
    assert shuffled[1].count() > sent[1].count() == 18  # all windows against those that may match
    assert lk.verbatim_leaks(d, c).count() == 1


Q = "The orlan desk in Port Sable pays 19769 credits for a new onboarding kit once 14 weeks have passed since Vinmoor agreed."


def test_reparameterised(spark):
    c = cases(spark, ("a", Q, "They asked Port Sable and Vinmoor, Norrvik and Castrel about it."))
    same = Q.replace("19769", "400").replace("14", "9").replace("Vinmoor", "Norrvik")
    twisted = "we saw 7 of 12 cats and 7 of 13 dogs and 8 of 12 birds today in town"
    c2 = cases(spark, ("b", "we saw 7 of 12 cats and 7 of 12 dogs and 7 of 12 birds today in town", None))
    got = lk.reparameterised_leaks(docs(spark, (1, same), (2, "nothing of it"), (3, Q)), c).collect()
    assert {(x.case_id, x.doc_id) for x in got} == {("a", 1)}
    assert lk.reparameterised_leaks(docs(spark, (1, twisted)), c2, min_fixed=5).count() == 0
    ok = twisted.replace("13", "12").replace("8 of", "7 of").replace("7 of", "5 of")
    assert lk.reparameterised_leaks(docs(spark, (1, ok)), c2, min_fixed=5).count() == 1


def test_substitutes_that_no_case_has(spark):
    c = cases(spark, ("a", Q, None), ("b", "Has the desk agreed to a new onboarding kit in weeks since it pays for once passed credits have", None))
    swap = lambda t, **by: " ".join(by.get(w.strip("."), w) + "." * w.endswith(".") for w in t.split())
    new = swap(Q, Port="Nether", Sable="Wickholm", Vinmoor="Ostrava")
    d = docs(spark, (1, new), (2, new.lower()), (3, swap(Q, orlan="zhugkelz")), (4, swap(Q, Vinmoor="Kit")), (5, Q), (6, swap(Q, the="those", pays="gives", kit="box", weeks="apples", have="had")))
    got = lk.reparameterised_leaks(d, c).collect()
    assert {(x.case_id, x.doc_id) for x in got} == {("a", 1), ("a", 2), ("a", 3), ("a", 4)}


def test_spelled_numbers_are_numbers(spark):
    q = "every site keeps nine copies of the ledger for seven weeks before they go to the vault in the cellar"
    c, d = cases(spark, ("a", q, None)), docs(spark, (1, q.replace("nine", "12").replace("seven", "thirty")), (2, q.replace("ledger", "nine")))
    assert {x.doc_id for x in lk.reparameterised_leaks(d, c).collect()} == {1}
    assert lk.verbatim_leaks(d, c).where("doc_id = 1").count() == 0


def test_more_held_out_words_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(lk, "MAX_NAMES", 1)
    c, d = cases(spark, ("a", Q, None)), docs(spark, (1, Q), (2, Q.replace("Vinmoor", "Ostrava")))
    assert {x.doc_id for x in lk.verbatim_leaks(d, c).where("n_windows = 10").collect()} == {1}
    assert {x.doc_id for x in lk.reparameterised_leaks(d, c).collect()} == {2}


def test_names_are_told_alike_however_many_words_are_sent(spark, monkeypatch):
    other = "Has the desk agreed to a new onboarding kit in weeks since it pays for once passed credits have"
    c = cases(spark, ("a", Q, None), ("b", other, Q.replace("orlan", "zhugkelz")), ("c", other, ""), (None, None, "The desk"))
    swap = lambda t, **by: " ".join(by.get(w.strip("."), w) + "." * w.endswith(".") for w in t.split())
    new = swap(Q, Port="Nether", Sable="Wickholm", Vinmoor="Ostrava")
    texts = [new, new.lower(), swap(Q, orlan="qeshtwyx"), swap(Q, Vinmoor="Kit"), Q, swap(Q, the="those", pays="gives", kit="box", weeks="apples", have="had"), new, "", None, "The desk"]
    d = docs(spark, *enumerate(texts), (None, new))
    found = {}
    for most in (1_000_000, 20, 8, 3, 0):
        monkeypatch.setattr(lk, "MAX_NAMES", most)
        found[most] = sorted(map(str, lk.reparameterised_leaks(d, c).collect()))
    assert all(x == found[1_000_000] for x in found.values())
    assert {(x.case_id, x.doc_id) for x in lk.reparameterised_leaks(d, c).collect()} >= {(i, k) for i in "ab" for k in (0, 1, 2, 3, 6, None)}


def test_words_of_most_cases_are_sent_and_the_others_joined(spark):
    lexicon = spark.createDataFrame([("the", 9), ("desk", 3), ("kit", 3), ("orlan", 1), ("vault", 1)], "word string, n long")
    split = lambda most: (lambda sent, rest: ([sorted(x) for x in sent], rest and sorted(r.word for r in rest.collect())))(*lk.split_literals(lexicon, most))
    assert split(5) == ([["desk", "kit", "orlan", "the", "vault"], ["desk", "kit", "the"]], None)
    assert split(4) == split(3) == ([["desk", "kit", "the"]] * 2, ["orlan", "vault"])
    assert split(2) == ([["the"]] * 2, ["desk", "kit", "orlan", "vault"])
    assert split(0) == ([[]] * 2, ["desk", "kit", "orlan", "the", "vault"])
    assert lk.split_literals(lexicon.limit(0), 0) == ([frozenset()] * 2, None)


def test_leakage_dirt(spark):
    c = cases(spark, ("a", None, None), ("b", "", "short"), ("c", Q, Q), ("c", Q, Q))
    d = docs(spark, (1, None), (2, ""), (3, Q), (3, Q), (4, "pad " * 30_000 + Q), (None, "nothing"))
    assert {(x.case_id, x.doc_id) for x in lk.verbatim_leaks(d, c).collect()} == {("c", 3), ("c", 4)}
    assert lk.verbatim_leaks(d.limit(0), c).count() == 0 and lk.verbatim_leaks(d, c.limit(0)).count() == 0


def test_words_that_come_with_a_capital_are_names(spark):
    got = {r.word for r in lk.name_lexicon(lk.held_out_texts(cases(spark, ("a", "In Port Sable and port Vinmoor they met", None)))).collect()}
    assert got == {"sable", "vinmoor"}


# --- spans --------------------------------------------------------------------------------------------------------------


def noise(r, n):
    return "".join(r.choice("abcdefgh \n") for _ in range(n))


def corpus(seed=3):
    r = random.Random(seed)
    base = [noise(r, 900) for _ in range(12)]
    out = {}
    for i in range(90):
        t = noise(r, r.randrange(0, 700))
        if i % 2:
            b, n = r.choice(base), r.choice([380, 399, 400, 401, 450, 800])
            k = r.randrange(0, len(b) - n)
            t += b[k : k + n] + noise(r, 50)
        if i % 10 == 9:
            t = out[i - 2]
        out[i] = t
    return out


def windows(t, n=400):
    return {t[k : k + n] for k in range(len(t) - n + 1)}


def test_spans_against_brute_force(spark):
    c = corpus()
    w = {i: windows(t) for i, t in c.items()}
    want = {(a, b) for a in c for b in c if a < b and w[a] & w[b]}
    df = docs(spark, *c.items())
    got = {(r.doc_id_a, r.doc_id_b) for r in sp.record_pairs(*sp.shared_spans(df)).collect()}
    assert got == want and len(want) > 20
    links, _ = sp.shared_spans(df)
    for r in links.collect():
        a, b = c[r.text_id_a], c[r.text_id_b]
        assert a[r.start_a : r.start_a + r.length] == b[r.start_b : r.start_b + r.length]


def test_crowded_passages_bring_no_pairs_and_lose_none(spark, monkeypatch):
    monkeypatch.setattr(sp, "CROWDED", 5)
    c = corpus(11)
    r = random.Random(12)
    footer = noise(r, 350)  # long enough for a mark, too short for a span
    c = {i: t + noise(r, 30) + footer for i, t in c.items()}
    w = {i: windows(t) for i, t in c.items()}
    want = {(a, b) for a in c for b in c if a < b and w[a] & w[b]}
    df = docs(spark, *c.items())
    assert {(x.doc_id_a, x.doc_id_b) for x in sp.record_pairs(*sp.shared_spans(df)).collect()} == want


def test_share_against_brute_force(spark):
    c = corpus(8)
    w = {i: windows(t) for i, t in c.items()}
    want = {}
    for i, t in c.items():
        others = set().union(*(w[j] for j in c if j != i))
        covered = set()
        for k in range(len(t) - 399):
            if t[k : k + 400] in others:
                covered.update(range(k, k + 400))
        if covered:
            want[i] = len(covered)
    assert {r.doc_id: r.shared_chars for r in sp.shared_share(docs(spark, *c.items())).collect()} == want


def test_span_dirt(spark):
    long = noise(random.Random(1), 150_000)
    df = docs(spark, (1, None), (2, ""), (3, "x" * 1000), (4, "x" * 1200), (5, long), (6, long[70_000:]), (6, long[70_000:]), (7, "😀" * 400), (8, "😀" * 401), (None, "😀" * 401))
    got = {(r.doc_id_a, r.doc_id_b) for r in sp.record_pairs(*sp.shared_spans(df)).collect()}
    assert got == {(3, 4), (5, 6), (7, 8)}
    assert sp.record_pairs(*sp.shared_spans(df.limit(0))).count() == 0 and sp.shared_share(df.limit(0)).count() == 0


def test_paragraph_repeats(spark):
    r = random.Random(6)
    p = [text(r, 40, 5000) for _ in range(6)]
    near = p[0].split()
    near[-1] = "changed"
    big = 1 << 60
    df = docs(spark, (1, f"{p[0]}\n\n{p[1]}\n\n# head"), (2, f"{' '.join(near)}\n \n{p[2]}\n\nHead"), (big, f"{p[1]}\r\n\r\n{p[1]}"), (4, None), (5, ""), (6, "***\n\n***"), (None, p[2]))
    got = {x.doc_id: (x.n_paragraphs, x.n_repeats) for x in sp.near_duplicate_paragraphs(df).collect()}
    assert got == {1: (3, 0), 2: (3, 2), big: (2, 2), 4: (0, 0), 5: (0, 0), 6: (2, 0)}
    assert {(x.doc_id_a, x.doc_id_b) for x in sp.paragraph_pairs(df).collect()} == {(1, 2), (1, big)}


def test_repetitive_texts_take_time_in_proportion(spark):
    import time

    r = random.Random(9)
    turn = noise(r, 700)
    df = docs(spark, (1, "ab" * 400_000), (2, "ba" * 300_000 + "c"), (3, "abc" * 200_000), (4, turn * 300), (5, noise(r, 100) + turn[350:] + turn[:340]))
    began = time.time()
    got = {(x.doc_id_a, x.doc_id_b) for x in sp.record_pairs(*sp.shared_spans(df)).collect()}
    assert got == {(1, 2), (4, 5)} and time.time() - began < 60
    shares = {x.doc_id: x.shared_chars for x in sp.shared_share(df).collect()}
    assert shares == {1: 800_000, 2: 600_000, 4: 206_310, 5: 690}


def test_texts_that_repeat_a_crowded_mark(spark, monkeypatch):
    monkeypatch.setattr(sp, "CROWDED", 4)
    r = random.Random(14)
    mark = noise(r, 340)
    body = lambda: noise(r, 500)
    shared = noise(r, 90)
    c = {i: body() + mark + body() for i in range(10)}
    # the second place of the common passage is inside a longer shared span
    c[20] = body() + mark + body() + shared + mark + body()
    c[21] = body() + shared + mark + body() + mark
    w = {i: windows(t) for i, t in c.items()}
    want = {(a, b) for a in c for b in c if a < b and w[a] & w[b]}
    assert want == {(20, 21)}
    assert {(x.doc_id_a, x.doc_id_b) for x in sp.record_pairs(*sp.shared_spans(docs(spark, *c.items()))).collect()} == want
