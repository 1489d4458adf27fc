import numpy as np
import pytest

from passagework.llm import pii
from passagework.llm import pii_model as pm
from passagework.llm.pii_corpus import Drawer, batch, labelled, tags_for
from passagework.llm.pii_train import measure, train


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger(pii.load_weights())


def found(tagger, text):
    return [(text[a:b], pm.KINDS[k]) for a, b, k in tagger.spans([text])[0]]


def test_gradients():
    p = {k: v.astype(np.float64) for k, v in pm.init(embed=4, hidden=5).items()}
    r = np.random.default_rng(0)
    ids, tags = r.integers(2, 100, (3, 8)).astype(np.int16), r.integers(0, pm.N_TAGS, (3, 8))
    ids[1, 5:] = 0
    _, g = pm.loss_and_grads(p, ids, tags)
    for k in p:
        at = tuple(r.integers(0, s) for s in p[k].shape)
        at = (int(ids[0, 1]), at[1]) if k == "emb" else at
        was, e = p[k][at], 1e-2
        p[k][at] = was + e
        up = pm.loss_and_grads(p, ids, tags)[0]
        p[k][at] = was - e
        down = pm.loss_and_grads(p, ids, tags)[0]
        p[k][at] = was
        assert g[k][at] == pytest.approx((up - down) / (2 * e), abs=2e-3)


def test_training_lowers_the_loss():
    drawer = Drawer(5)
    before = pm.loss_and_grads(pm.init(hidden=16, seed=3), *batch(drawer, 32, 64))[0]
    p = train(12, size=16, width=64, start=pm.init(hidden=16, seed=3), workers=2, say=lambda *a, **k: None)
    assert pm.loss_and_grads(p, *batch(Drawer(5), 32, 64))[0] < 0.6 * before


def test_accuracy_on_registers_never_trained_on():
    got = measure(pii.load_weights(), texts=600)
    assert all(p > 0.9 and r > (0.85 if k == "person_name" else 0.93) for k, (p, r) in got.items()), got


def test_reader_agrees_with_the_training_pass():
    w = pii.load_weights()
    ids = np.random.default_rng(3).integers(2, 99, (5, 40)).astype(np.int16)
    ids[1, 20:], ids[4, 1:] = 0, 0
    want, got = pm._forward(w, ids)[0], pm.Reader(w)(ids)
    assert np.abs(want - got)[ids != 0].max() < 1e-4


def test_outside_the_open_runs_nothing_is_tagged():
    r = np.random.default_rng(4)
    seen = 0
    for _ in range(200):
        tr = pm.allowed_transitions(r.normal(size=(pm.N_TAGS, pm.N_TAGS)))
        lengths = r.integers(1, 12, 5)
        e = (r.normal(size=(int(lengths.sum()), pm.N_TAGS)) * r.choice([0.5, 3])).astype(np.float32)
        e[:, 0] += r.choice([0, 3, 6])
        starts, stops = pm.open_runs(e, np.cumsum(lengths), tr)
        inside = np.zeros(len(e), bool)
        for a, b in zip(starts, stops):
            inside[a:b] = True
        at = 0
        for n in lengths:
            tags = pm.viterbi(e[None, at : at + n], tr, np.array([n]))[0]
            assert not tags[~inside[at : at + n]].any()
            at += n
        seen += int((~inside).sum())
    assert seen > 500


def test_runs_decoded_alone_give_the_path_of_the_text(tagger):
    drawer = Drawer(31)
    texts = ["", "a", *(labelled(drawer)[0] for _ in range(300))]
    whole = []
    for t in texts:
        ids = pm.encode(t)
        tags = pm.viterbi(tagger._scores([ids])[0][None], tagger.tr, np.array([len(ids)]))[0] if len(ids) else np.empty(0)
        got = sorted({x for a, b, k in pii.whole_words(t, pm.spans_of(tags)) if (x := pii.settle(t, a, b, k))})
        whole.append([x for i, x in enumerate(got) if not i or x[0] >= max(y[1] for y in got[:i])])
    assert tagger.spans(texts) == whole


def test_sentences_of_everyday(tagger):
    assert found(tagger, "reach Alice at alice@example.com") == [("Alice", "person_name"), ("alice@example.com", "email")]
    assert found(tagger, "(12 rue de la Paix, 75002 Paris) est incomplet") == [("12 rue de la Paix, 75002 Paris", "street_address")]
    assert found(tagger, "my mobile is 07911 123456") == [("07911 123456", "phone")]
    assert found(tagger, "Dear Madam, the bill is late") == []
    assert found(tagger, "Jean-Pierre Dubois a téléphoné") == [("Jean-Pierre Dubois", "person_name")]


def test_mentions_and_lookalikes(tagger):
    assert found(tagger, "pls ring me: 746-555-0178 (Ilvane Grasridge)") == [("746-555-0178", "phone"), ("Ilvane Grasridge", "person_name")]
    assert found(tagger, "why was Ms Zoëlle Veldulin rejected for Brackenfield") == [("Zoëlle Veldulin", "person_name")]
    assert found(tagger, "forward to flornmere [at] harrowpost [dot] test and jorrell.ingleridge@harrowmail.example") == [("flornmere [at] harrowpost [dot] test", "email"), ("jorrell.ingleridge@harrowmail.example", "email")]
    for text in ("why was invoice 816-82-9847 rejected", "who is behind deploy@build-4", "block traffic from 192.0.2.93 on the currency table", "asset QA584009 lost in Windle Cross", "contract with Lornwick & Sons"):
        assert found(tagger, text) == []


def test_windows_are_reconciled(tagger):
    plain = "The quarterly runbook is kept for 58 calendar days [2]. "
    text = plain * 40 + "Signed by Torvin Ostridge in Norrvik. " + plain * 40
    assert found(tagger, text) == [("Torvin Ostridge", "person_name")]
    for shift in range(0, 160, 23):
        t = "x" * shift + " " + text
        assert ("Torvin Ostridge", "person_name") in found(tagger, t)


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    e, tr = r.normal(size=(1, 4, pm.N_TAGS)), pm.allowed_transitions(r.normal(size=(pm.N_TAGS, pm.N_TAGS)))
    import itertools

    def score(path):
        return (e[0, 0, path[0]] if path[0] == 0 or path[0] % 2 else -1e4) + sum(tr[a, b] + e[0, i + 1, b] for i, (a, b) in enumerate(zip(path, path[1:])))

    best = max(itertools.product(range(pm.N_TAGS), repeat=4), key=score)
    assert tuple(pm.viterbi(e, tr, np.array([4]))[0]) == best


def test_redaction_keeps_the_rest(tagger):
    drawer = Drawer(77)
    for _ in range(50):
        text, _ = labelled(drawer)
        spans = tagger.spans([text])[0]
        out, at = pii.redact(text, spans), 0
        for a, b, k in spans:
            tag = f"[{pm.KINDS[k].upper()}]"
            i = out.index(tag, at)
            assert out[at:i] == text[(at and last) : a] if at else out[:i] == text[:a]
            at, last = i + len(tag), b
        assert out[at:] == text[(last if spans else 0) :]


def test_tags_and_spans_are_inverse():
    spans = [(0, 3, 4), (3, 5, 4), (7, 9, 0)]
    assert pm.spans_of(tags_for(10, spans)) == spans


def test_dirty_rows(spark):
    rows = [("query", 1, "call Orsanne Quenridge on 020 7946 0398"), ("query", 1, "call Orsanne Quenridge on 020 7946 0398"), ("query", 2, None), ("query", 3, ""), ("answer", 1, "   "), ("answer", 2, "x" * 50_000), ("answer", 3, "😀 日本")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "record_kind string, record_id long, text string, entity_kind string")
    got = {(r.record_kind, r.record_id, r.entity_kind, r.start_pos) for r in pii.mentions(df).collect()}
    assert got == {("query", 1, "person_name", 6), ("query", 1, "phone", 27)}
    red = {(r.record_kind, r.record_id): r.redacted for r in pii.redacted(df).collect()}
    assert red[("query", 1)] == "call [PERSON_NAME] on [PHONE]" and red[("query", 2)] is None and red[("query", 3)] == "" and red[("answer", 2)] == "x" * 50_000
    assert pii.mentions(df.limit(0)).count() == 0
