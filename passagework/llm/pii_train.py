"""python -m passagework.llm.pii_train [SECONDS] [--more]: trains the tagger on all cores and writes pii_weights.npz."""

from __future__ import annotations

import os
import sys

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # one process per core

import multiprocessing as mp  # noqa: E402
import time  # noqa: E402
from pathlib import Path  # noqa: E402

import numpy as np  # noqa: E402

from passagework.llm.pii_corpus import Drawer, batch, labelled, vocabulary  # noqa: E402
from passagework.llm.pii_model import KINDS, Adam, init, loss_and_grads  # noqa: E402

WEIGHTS = Path(__file__).with_name("pii_weights.npz")


def _views(buffer, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    flat, at, out = np.frombuffer(buffer, np.float32), 0, {}
    for k, v in like.items():
        out[k] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return out


def _work(rank: int, like: dict, shared, grads, losses, barrier, stop, size: int, width: int, seed: int) -> None:
    """Gradients of one share of every batch."""
    p, g = _views(shared, like), _views(grads[rank], like)
    vocab = vocabulary()
    drawer = Drawer(seed * 1_000_003 + rank, vocab)
    while True:
        loss, own = loss_and_grads(p, *batch(drawer, size, width))
        for k in g:
            g[k][...] = own[k]
        losses[rank] = loss
        barrier.wait()  # gradients are there
        barrier.wait()  # weights are new
        if stop.value:
            return


def train(seconds: float, size: int = 64, width: int = 160, seed: int = 3, rate: float = 6e-3, start: dict | None = None, workers: int = 0, say=print) -> dict[str, np.ndarray]:
    """Every step takes `size` texts from each worker; the mean of their gradients moves the one set of weights."""
    like = start or init(seed=seed)
    n = sum(v.size for v in like.values())
    ctx, workers = mp.get_context("spawn"), workers or os.cpu_count() or 1
    shared, grads, losses = ctx.RawArray("f", n), [ctx.RawArray("f", n) for _ in range(workers)], ctx.RawArray("d", workers)
    p = _views(shared, like)
    for k in p:
        p[k][...] = like[k]
    barrier, stop = ctx.Barrier(workers + 1), ctx.Value("b", 0)
    team = [ctx.Process(target=_work, args=(r, like, shared, grads, losses, barrier, stop, size, width, seed), daemon=True) for r in range(workers)]
    for t in team:
        t.start()
    adam, began, steps, recent = Adam(p), time.time(), 0, []
    theirs = [_views(x, like) for x in grads]
    while not stop.value:
        barrier.wait()
        spent = (time.time() - began) / seconds
        adam.step(p, {k: sum(t[k] for t in theirs) / workers for k in p}, rate * min(1, (steps + 1) / 30) * max(0.0, 1 - spent) ** 0.8)
        recent = [*recent[-49:], float(np.mean(losses))]
        steps += 1
        stop.value = int(spent >= 1)
        if steps % 200 == 0:
            say(f"{steps} steps, loss {np.mean(recent):.3f}, {time.time() - began:.0f} s", flush=True)
        barrier.wait()
    for t in team:
        t.join()
    return {k: v.copy() for k, v in p.items()}


def measure(p: dict, texts: int = 2000, seed: int = 999_983, held_out: bool = True) -> dict[str, tuple[float, float]]:
    """(precision, recall) of (kind, start) per kind, over texts of registers that were never trained on."""
    from passagework.llm.pii import Tagger

    drawer = Drawer(seed)
    pairs = [labelled(drawer, held_out) for _ in range(texts)]
    found = Tagger(p).spans([t for t, _ in pairs])
    want = {(i, k, a) for i, (_, s) in enumerate(pairs) for a, _, k in s}
    got = {(i, k, a) for i, s in enumerate(found) for a, _, k in s}
    of = lambda xs, k: {x for x in xs if x[1] == k}
    return {name: (round(len(of(want & got, k)) / max(1, len(of(got, k))), 4), round(len(of(want & got, k)) / max(1, len(of(want, k))), 4)) for k, name in enumerate(KINDS)}


if __name__ == "__main__":
    from passagework.llm.pii import load_weights

    more = "--more" in sys.argv  # goes on from the weights there are
    params = train(float(sys.argv[1]) if len(sys.argv) > 1 else 480, rate=3e-3 if more else 6e-3, seed=int(time.time()) if more else 3, start=load_weights(WEIGHTS) if more else None)
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in params.items()})
    rounded = {k: v.astype(np.float16).astype(np.float32) for k, v in params.items()}
    print("registers trained on", measure(rounded, held_out=False))
    print("registers held out", measure(rounded))
