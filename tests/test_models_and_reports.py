import datetime as dt
import json
from decimal import Decimal
from pathlib import PurePosixPath

import numpy as np
import pytest

from passagework.operators import embedding as em
from passagework.operators import evaluation as ev
from passagework.operators import retrieval as rt


def test_hashing_embedder():
    m = em.HashingEmbedder(32)
    v = m.documents(["leave policy", "Leave, policy!", "", None])
    assert np.allclose(v[0], v[1]) and np.linalg.norm(v[0]) == pytest.approx(1) and not v[2:].any()


def test_only_stale_chunks_are_embedded_again(spark):
    s = "chunk_id long, section_path string, content string, embedding array<float>, embedding_model string"
    rows = [(1, "a", "b", [1.0, 0.0], "hashing-2"), (2, "a", "b", [1.0, 0.0], "old"), (3, "a", "b", None, "hashing-2"), (4, None, None, [0.0, 0.0], "hashing-2"), (5, "a", "b", [None, 1.0], "hashing-2")]
    df = spark.createDataFrame(rows, s)
    assert {r.chunk_id for r in em.stale(df, "hashing-2", 2).collect()} == {2, 3, 4, 5}
    got = {r.chunk_id: r for r in em.reembedded(df, lambda: em.HashingEmbedder(2), "hashing-2", 2).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1].embedding == [1.0, 0.0] and got[2].embedding_model == "hashing-2"
    with pytest.raises(Exception, match="components"):
        em.reembedded(df, lambda: em.HashingEmbedder(3), "hashing-2", 2).collect()


def test_a_failing_model_keeps_the_fused_order(spark):
    rows = [("q", i, i, "question", f"passage {i}") for i in (1, 2, 3)]
    fused = spark.createDataFrame(rows, "request_id string, chunk_id long, position int, question string, passage string")

    def last_first():
        return lambda pairs: [float(p[1].split()[1]) for p in pairs]

    def broken():
        raise RuntimeError("no model")

    order = lambda df: [r.chunk_id for r in df.orderBy("position").collect()]
    assert order(rt.rerank_with_model(fused, last_first, 2)) == [3, 2]
    assert order(rt.rerank_with_model(fused, broken, 2)) == [1, 2]


def test_reports(tmp_path):
    path = ev.save_report([{"at": dt.date(2025, 1, 1), "cost": Decimal("0.5"), "s": {"b", "a"}, "p": PurePosixPath("x/y"), "t": (1, 2)}], str(tmp_path / "r"), "run")
    assert json.loads(open(path).read()) == [{"at": "2025-01-01", "cost": 0.5, "s": ["a", "b"], "p": "x/y", "t": [1, 2]}]
