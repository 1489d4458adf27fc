"""Character-level bidirectional LSTM with CRF transitions, in numpy: forward, backward, Adam, Viterbi."""

from __future__ import annotations

import unicodedata

import numpy as np

KINDS = ("email", "phone", "identity_number", "street_address", "person_name")
#: 0 outside; 1 + 2k begins kind k, 2 + 2k continues it.
N_TAGS = 1 + 2 * len(KINDS)
_PRINTABLE = {chr(c): c - 30 for c in range(32, 127)}
PAD, OTHER, LETTER, DIGIT, BREAK = 0, 1, 97, 98, 99
N_CHARS = 100


class _Chars(dict):
    def __missing__(self, c: str) -> int:
        base = unicodedata.normalize("NFKD", c)[0]
        v = _PRINTABLE.get(c) or (BREAK if c in "\n\r" else _PRINTABLE[" "] if c.isspace() else None)
        v = v or _PRINTABLE.get(base) or (DIGIT if c.isdigit() else LETTER if c.isalpha() else OTHER)
        self[c] = v
        return v


_chars = _Chars()


def encode(text: str) -> np.ndarray:
    return np.fromiter(map(_chars.__getitem__, text), np.int16, len(text))


def init(embed: int = 24, hidden: int = 48, seed: int = 1) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    g = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
    p = {"emb": (r.standard_normal((N_CHARS, embed)) * 0.3).astype(np.float32), "wx": g(2, embed, 4 * hidden), "wh": g(2, hidden, 4 * hidden), "b": np.zeros((2, 1, 4 * hidden), np.float32), "wo": g(2 * hidden, N_TAGS), "bo": np.zeros(N_TAGS, np.float32), "tr": np.zeros((N_TAGS, N_TAGS), np.float32)}
    p["b"][:, :, hidden : 2 * hidden] = 1
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Reader:
    """The forward pass alone, in place: the halves of sigmoid(x) = (tanh(x / 2) + 1) / 2 are put into the weights, so that
    one tanh does for all gates (states are kept doubled), and a padding character shuts the input gate, so that no mask
    is needed."""

    def __init__(self, p: dict):
        h = p["wh"].shape[1]
        scale = np.ones(4 * h, np.float32)
        scale[: 3 * h] = 0.5
        table = (np.matmul(p["emb"][None], p["wx"]) + p["b"]) * scale
        table[:, PAD, :h] = -30
        self.h, self.table, self.wh, self.wo, self.bo = h, np.ascontiguousarray(table), p["wh"] * scale / 2, p["wo"] / 2, p["bo"]

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        """ids (B, T), PAD at the end. Scores (B, T, tags)."""
        (b, t), h = ids.shape, self.h
        ahead, back = np.ascontiguousarray(ids.T), np.ascontiguousarray(ids.T[::-1])
        hs = np.zeros((t + 1, 2, b, h), np.float32)
        z, c, tmp = np.empty((2, b, 4 * h), np.float32), np.zeros((2, b, h), np.float32), np.empty((2, b, h), np.float32)
        inputs = np.empty((2, b, 4 * h), np.float32)
        gates = z[..., : 3 * h]
        i, f, o, g = (z[..., k * h : (k + 1) * h] for k in range(4))
        for s in range(t):
            np.matmul(hs[s], self.wh, out=z)
            np.take(self.table[0], ahead[s], axis=0, out=inputs[0], mode="clip")
            np.take(self.table[1], back[s], axis=0, out=inputs[1], mode="clip")
            z += inputs
            np.tanh(z, out=z)
            gates += 1
            c *= f
            np.multiply(i, g, out=tmp)
            c += tmp
            c *= 0.5
            np.tanh(c, out=tmp)
            np.multiply(o, tmp, out=hs[s + 1])
        e = hs[1:, 0] @ self.wo[:h]
        e += hs[:0:-1, 1] @ self.wo[h:]
        e += self.bo
        return e.transpose(1, 0, 2)


def _forward(p: dict, ids: np.ndarray):
    b, t = ids.shape
    h4 = p["wh"].shape[2]
    h = h4 // 4
    # the input side depends on the character alone: a table of as many rows as there are characters
    table = np.matmul(p["emb"][None], p["wx"]) + p["b"]
    both = np.stack([ids, ids[:, ::-1]])
    live = (both != PAD).astype(np.float32)
    hs = np.zeros((t + 1, 2, b, h), np.float32)
    cs = np.zeros((t + 1, 2, b, h), np.float32)
    gates = np.empty((t, 2, b, h4), np.float32)
    c = np.zeros((2, b, h), np.float32)
    for s in range(t):
        z = np.matmul(hs[s], p["wh"])
        z[0] += table[0][both[0, :, s]]
        z[1] += table[1][both[1, :, s]]
        z[..., : 3 * h] = _sigmoid(z[..., : 3 * h])
        z[..., 3 * h :] = np.tanh(z[..., 3 * h :])
        i, f, o, g = z[..., :h], z[..., h : 2 * h], z[..., 2 * h : 3 * h], z[..., 3 * h :]
        m = live[:, :, s, None]
        c = (f * c + i * g) * m
        hs[s + 1] = o * np.tanh(c) * m
        gates[s], cs[s + 1] = z, c
    top = np.concatenate([hs[1:, 0], hs[:0:-1, 1]], axis=2).transpose(1, 0, 2)
    return top @ p["wo"] + p["bo"], top, hs, cs, gates, both, live


def loss_and_grads(p: dict, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    b, t = ids.shape
    em, top, hs, cs, gates, both, live = _forward(p, ids)
    mask = ids != PAD
    tr, e = p["tr"].astype(np.float64), em.astype(np.float64)
    # CRF: forward and backward sums as probabilities scaled at every step; padding is carried through
    high = e.max(2, keepdims=True)
    scores, step = np.exp(e - high).transpose(1, 0, 2).copy(), np.exp(tr)
    on = mask.T[:, :, None]
    alpha, beta, scale = np.empty((t, b, N_TAGS)), np.ones((t, b, N_TAGS)), np.ones((t, b, 1))
    scale[0] = scores[0].sum(1, keepdims=True)
    alpha[0] = scores[0] / scale[0]
    for s in range(1, t):
        a = (alpha[s - 1] @ step) * scores[s]
        total = a.sum(1, keepdims=True)
        alpha[s] = np.where(on[s], a / total, alpha[s - 1])
        scale[s] = np.where(on[s], total, 1.0)
    log_z = np.log(scale)[:, :, 0].sum(0) + (high[:, :, 0] * mask).sum(1)
    for s in range(t - 2, -1, -1):
        beta[s] = np.where(on[s + 1], (scores[s + 1] * beta[s + 1] / scale[s + 1]) @ step.T, beta[s + 1])
    after = np.where(on[1:], scores[1:] * beta[1:] / scale[1:], 0.0)
    d_tr = step * (alpha[:-1].reshape(-1, N_TAGS).T @ after.reshape(-1, N_TAGS))
    d_em = (alpha * beta).transpose(1, 0, 2) * mask[:, :, None]
    rows, cols = np.nonzero(mask)
    gold = e[rows, cols, tags[rows, cols]].sum()
    d_em[rows, cols, tags[rows, cols]] -= 1
    pair = mask[:, 1:]
    was, now = tags[:, :-1][pair], tags[:, 1:][pair]
    gold += tr[was, now].sum()
    np.subtract.at(d_tr, (was, now), 1)
    n = b
    loss = (log_z.sum() - gold) / n
    d_em = (d_em / n).astype(np.float32)
    g = {"tr": (d_tr / n).astype(np.float32), "wo": top.reshape(-1, top.shape[2]).T @ d_em.reshape(-1, N_TAGS), "bo": d_em.sum((0, 1))}
    d_top = d_em @ p["wo"].T
    h = top.shape[2] // 2
    d_hs = np.stack([d_top[:, :, :h].transpose(1, 0, 2), d_top[:, ::-1, h:].transpose(1, 0, 2)], 1)
    d_wh, d_table = np.zeros_like(p["wh"]), np.zeros((2, N_CHARS, 4 * h), np.float32)
    dh, dc = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
    dz = np.empty((2, b, 4 * h), np.float32)
    all_dz = np.empty((t, 2, b, 4 * h), np.float32)
    wht = p["wh"].transpose(0, 2, 1).copy()
    for s in range(t - 1, -1, -1):
        z, m = gates[s], live[:, :, s, None]
        i, f, o, gg = z[..., :h], z[..., h : 2 * h], z[..., 2 * h : 3 * h], z[..., 3 * h :]
        tc = np.tanh(cs[s + 1])
        dh = (dh + d_hs[s]) * m
        dc = (dc + dh * o * (1 - tc * tc)) * m
        dz[..., :h] = dc * gg * i * (1 - i)
        dz[..., h : 2 * h] = dc * cs[s] * f * (1 - f)
        dz[..., 2 * h : 3 * h] = dh * tc * o * (1 - o)
        dz[..., 3 * h :] = dc * i * (1 - gg * gg)
        all_dz[s] = dz
        dh, dc = np.matmul(dz, wht), dc * f
    for d in range(2):
        flat = all_dz[:, d].reshape(-1, 4 * h)
        d_wh[d] = hs[:-1, d].reshape(-1, h).T @ flat
        hot = np.zeros((N_CHARS, t * b), np.float32)
        hot[both[d].T.reshape(-1), np.arange(t * b)] = 1
        d_table[d] = hot @ flat
    g["wh"], g["b"] = d_wh, d_table.sum(1, keepdims=True)
    g["wx"] = np.matmul(p["emb"].T[None], d_table)
    g["emb"] = sum(d_table[d] @ p["wx"][d].T for d in range(2))
    return float(loss), g


class Adam:
    def __init__(self, p: dict, rate: float = 4e-3):
        self.m, self.v, self.t, self.rate = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0, rate

    def step(self, p: dict, g: dict, rate: float) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, 5.0 / (norm + 1e-6))
        for k in p:
            x = g[k] * scale
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            p[k] -= (rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def allowed_transitions(tr: np.ndarray) -> np.ndarray:
    """A continuation follows its own kind only."""
    out = tr.astype(np.float64).copy()
    for k in range(len(KINDS)):
        for a in range(N_TAGS):
            if a not in (1 + 2 * k, 2 + 2 * k):
                out[a, 2 + 2 * k] = -1e4
    return out


def open_runs(e: np.ndarray, ends: np.ndarray, tr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """e: scores of texts one after the other (N, tags); ends: where each ends. The runs of characters (start, end) outside
    which the best path of every text is the outside tag for certain: what any run of other tags that holds such a
    character could gain over outside, begun by a tag that begins and with the best of all transitions, is less than nothing."""
    base, outside = tr[0, 0], e[:, 0].astype(np.float64)
    lengths = np.diff(np.concatenate([[0], ends]))
    at = np.arange(len(e)) + 1 + np.repeat(np.arange(len(ends)), lengths)
    flat, enter = np.full((2, len(e) + len(ends) + 1), -1e6)  # a wall before, between and after the texts
    flat[at] = (e[:, 1:] + tr[1:, 1:].max(0)).max(1) - outside - base
    enter[at] = (e[:, 1::2] + tr[0, 1::2]).max(1) - outside - base
    firsts = np.concatenate([[0], ends[:-1]])
    enter[at[firsts]] = e[firsts, 1::2].max(1) - outside[firsts]  # nothing comes before the first character
    leave = max(0.0, float(tr[1:, 0].max() - base))
    total = np.cumsum(flat)
    left = total + np.maximum.accumulate(enter - total)  # best run that has begun and goes to here
    right = np.maximum.accumulate(total[::-1])[::-1] - total  # what going on can add
    maybe = (left + right + leave >= -1e-3).astype(np.int8)
    maybe[[0, -1]] = 0
    turn = np.diff(maybe)
    starts, stops = np.flatnonzero(turn == 1) + 1, np.flatnonzero(turn == -1) + 1
    walls = np.cumsum(flat == -1e6)
    return starts - walls[starts], stops - walls[starts]


def viterbi(e: np.ndarray, tr: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Best tags of each text of a padded batch (B, T, tags)."""
    b, t, n = e.shape
    score = e[:, 0].copy()
    score[:, 2::2] = -1e4
    back = np.empty((t, b, n), np.int8)
    for s in range(1, t):
        total = score[:, :, None] + tr[None]
        back[s] = total.argmax(1)
        new = total.max(1) + e[:, s]
        score = np.where((s < lengths)[:, None], new, score)
    out = []
    for r in range(b):
        k = int(score[r].argmax())
        tags = np.empty(lengths[r], np.int8)
        for s in range(lengths[r] - 1, -1, -1):
            tags[s] = k
            if s:
                k = int(back[s, r, k])
        out.append(tags)
    return out


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of each labelled span."""
    out, start = [], None
    for i, t in enumerate(tags.tolist() + [0]):
        if start is not None and (t == 0 or t % 2 == 1):
            out.append((start, i, (tags[start] - 1) // 2))
            start = None
        if t and start is None:
            start = i
    return out
