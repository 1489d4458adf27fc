"""Personal information inside free text: located, typed and replaced by placeholders.

Texts are deduplicated, then tagged by the character-level model of pii_model in Arrow batches. A text longer than a
window is read in overlapping windows; their scores are blended by the distance from the window's edge, and one Viterbi
pass over the whole text reconciles them. Boundaries are then checked exactly: spans start and end at a word's edge,
without courtesy titles. A span that lacks what its kind cannot be without is none: an email its at, a phone or identity
number five digits, a name or an address a letter.

Defined results: null and empty texts have no mention and stay as they are; repeated rows of one id count once; texts of
any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.pii_model import KINDS, Reader, allowed_transitions, encode, open_runs, spans_of, viterbi
from passagework.workspace import parallelism

WEIGHTS = Path(__file__).with_name("pii_weights.npz")
WINDOW, STRIDE = 320, 256
_TITLE = re.compile(r"(?:mrs|mr|ms|miss|dr|prof)\.?\s+", re.IGNORECASE)
_EDGE = {"email": "<([\"' ,;:.", "phone": "<[\"' ,;:.", "identity_number": "<([\"' ,;:.#", "street_address": "<([\"' ,;:.\n", "person_name": "<([\"' ,;:.\n"}
_TAIL = {"email": ">)]\"' ,;:.?!\n", "phone": ">]\"' ,;:.?!\n(", "identity_number": ">)]\"' ,;:.?!\n", "street_address": ">)]\"' ,;:.?!\n", "person_name": ">)]\"' ,;:?!\n"}


def load_weights(path: Path = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(path) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def whole_words(text: str, spans: list[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
    """The spans widened to the edges of the words they begin and end in; every word is looked up once."""
    if not spans:
        return set()
    inner = np.fromiter(map(str.isalnum, text), bool, len(text))
    at = np.arange(len(text))
    first = np.maximum.accumulate(np.where(inner, -1, at)) + 1  # of a word's characters: where it begins
    last = len(text) - 1 - np.maximum.accumulate(np.where(inner[::-1], -1, at))[::-1]  # where it ends
    return {(int(first[a]) if inner[a] else a, int(last[b - 1]) if inner[b - 1] else b, k) for a, b, k in spans}


def settle(text: str, start: int, end: int, kind: int) -> tuple[int, int, int] | None:
    """The exact boundaries of a tagged span, or None if it lacks what its kind cannot be without."""
    name = KINDS[kind]
    while start < end and text[start] in _EDGE[name]:
        start += 1
    while end > start and text[end - 1] in _TAIL[name]:
        end -= 1
    if name == "person_name":
        if m := _TITLE.match(text, start, end):
            start = m.end()
        if text[start:end].endswith(("'s", "’s")):
            end -= 2
    span = text[start:end]
    digits = sum(c.isdigit() for c in span)
    # what a kind cannot be without; no bound on how long or how many
    fine = {"email": "@" in span or re.search(r"\bat\b", span, re.IGNORECASE), "phone": digits >= 5, "identity_number": digits >= 5, "street_address": any(map(str.isalpha, span)), "person_name": any(map(str.isalpha, span))}
    return (start, end, kind) if fine[name] else None


class Tagger:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.read, self.n_tags = Reader(weights), weights["wo"].shape[1]
        self.tr = allowed_transitions(weights["tr"])

    def _scores(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """Blended scores of every character of every text."""
        scores: list[np.ndarray | None] = [None] * len(ids)
        weight: dict[int, np.ndarray] = {}
        cuts = [(min(WINDOW, len(x) - s), i, s) for i, x in enumerate(ids) for s in (range(0, max(1, len(x) - WINDOW + STRIDE), STRIDE))]
        cuts.sort()
        for c in range(0, len(cuts), 256):
            part = cuts[c : c + 256]
            block = np.zeros((len(part), part[-1][0]), np.int16)
            for r, (n, i, s) in enumerate(part):
                block[r, :n] = ids[i][s : s + n]
            e = self.read(block)
            for r, (n, i, s) in enumerate(part):
                if n == len(ids[i]):
                    scores[i] = e[r, :n]
                    continue
                if scores[i] is None:
                    scores[i], weight[i] = np.zeros((len(ids[i]), self.n_tags), np.float32), np.zeros((len(ids[i]), 1), np.float32)
                edge = np.minimum(np.arange(n) + (1 if s else WINDOW), np.arange(n, 0, -1) + (0 if s + n < len(ids[i]) else WINDOW))
                v = np.minimum(edge, 40).astype(np.float32)[:, None]
                scores[i][s : s + n] += e[r, :n] * v
                weight[i][s : s + n] += v
        return [s / np.maximum(weight[i], 1) if i in weight else s for i, s in enumerate(scores)]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        out: list[list[tuple[int, int, int]]] = []
        ids = [encode(t) for t in texts]
        begin = 0
        while begin < len(texts):
            # as many texts as keep the scores small; a longer one by itself
            end, held = begin + 1, len(ids[begin])
            while end < len(texts) and held + len(ids[end]) <= 1 << 19:
                held += len(ids[end])
                end += 1
            out += self._decoded(texts[begin:end], ids[begin:end])
            begin = end
        return out

    def _decoded(self, texts: list[str], ids: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        full = [i for i, x in enumerate(ids) if len(x)]
        if not full:
            return out
        ends = np.cumsum([len(ids[i]) for i in full])
        e = np.concatenate(self._scores([ids[i] for i in full]))
        starts, stops = open_runs(e, ends, self.tr)
        own = np.searchsorted(ends, starts, "right")
        # a character of the outside tag on either side, where the text has one
        starts_, stops_ = np.maximum(starts - 1, np.where(own > 0, ends[own - 1], 0)), np.minimum(stops + 1, ends[own])
        order, found, s = np.argsort(stops_ - starts_, kind="stable"), {}, 0
        while s < len(order):
            # as many runs of like length as keep the block small
            most = int((stops_ - starts_)[order[min(len(order), s + 512) - 1]])
            part = order[s : s + max(1, min(512, (1 << 18) // most))]
            s += len(part)
            lengths = (stops_ - starts_)[part]
            block = np.zeros((len(part), int(lengths.max()), self.n_tags), np.float32)
            for r, j in enumerate(part):
                block[r, : lengths[r]] = e[starts_[j] : stops_[j]]
                if starts_[j] < starts[j]:
                    block[r, 0, 1:] = -1e9
                if stops_[j] > stops[j]:
                    block[r, lengths[r] - 1, 1:] = -1e9
            for j, tags in zip(part, viterbi(block, self.tr, lengths)):
                found[int(j)] = tags
        tagged: dict[int, list] = {}
        for j in range(len(starts)):
            at = int(starts_[j]) - (int(ends[own[j] - 1]) if own[j] else 0)
            tagged.setdefault(full[own[j]], []).extend((a + at, b + at, k) for a, b, k in spans_of(found[j]))
        for i, spans in tagged.items():
            last = -1
            for x in sorted({x for a, b, k in whole_words(texts[i], spans) if (x := settle(texts[i], a, b, k))}):
                if x[0] >= last:
                    out[i].append(x)
                    last = x[1]
        return out


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, last = [], 0
    for a, b, k in spans:
        out += [text[last:a], f"[{KINDS[k].upper()}]"]
        last = b
    return "".join(out) + text[last:]


MENTIONS = "text string, redacted string, mentions array<struct<entity_kind:string,start_pos:int,end_pos:int>>"


def tag_texts(texts: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """texts: text. One row per different text: text, redacted, mentions (1-based start, inclusive end)."""
    spark = texts.sparkSession
    model = spark.sparkContext.broadcast(weights or load_weights())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model.value)
        for pdf in batches:
            if not len(pdf):
                continue
            own = pdf["text"].tolist()
            found = tagger.spans(own)
            yield pd.DataFrame({"text": own, "redacted": [redact(t, s) for t, s in zip(own, found)], "mentions": [[{"entity_kind": KINDS[k], "start_pos": a + 1, "end_pos": b} for a, b, k in s] for s in found]})

    # little data, much work: told apart by text first, then over all cores
    once = texts.where("text is not null").select("text").distinct()
    return once.repartition(parallelism(spark), F.xxhash64("text")).mapInPandas(run, MENTIONS)


def mentions(records: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """records: record_kind, record_id, text. record_kind, record_id, entity_kind, start_pos, end_pos, once per id."""
    tagged = tag_texts(records, weights).where(F.size("mentions") > 0).select("text", "mentions")
    own = records.where("text is not null").select("record_kind", "record_id", "text").distinct()
    return own.join(tagged, "text").select("record_kind", "record_id", F.explode("mentions").alias("m")).select("record_kind", "record_id", "m.entity_kind", "m.start_pos", "m.end_pos").distinct()


def redacted(records: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """records with placeholders: record_kind, record_id, redacted; null texts stay null."""
    own = records.select("record_kind", "record_id", "text").distinct()
    return own.join(tag_texts(records, weights).select("text", "redacted"), "text", "left").select("record_kind", "record_id", "redacted")
