"""Splitting oversized items at natural boundaries.

Sizes are measured on the JVM side; only items over the limit reach Python, where dynamic programming over boundary
positions picks the cuts: it minimises the sum of cut penalties and squared deviations from the even size, under the
limit for heading trail, overlap and body together.

Defined results: null ids stay null; null or blank texts and items at or under the limit give no piece; a null trail is no trail; equal
costs are settled by the earlier cut; a repeated item is cut again; text without boundaries is cut on a fixed
grid; a trail that leaves less than `min_body` tokens keeps its innermost part (`trail_cut`); other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.workspace import parallelism

SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PROSE, CODE = 3.8, 2.9


@dataclass(frozen=True)
class Limits:
    max_tokens: int = 700
    overlap: int = 60
    min_body: int = 150


def token_count(text: Column, ratio: Column | float = PROSE) -> Column:
    n = F.length(F.trim(F.regexp_replace(text, f"{SPACE}+", " ")))
    r = F.lit(ratio) if isinstance(ratio, float) else ratio
    return F.when(text.isNull() | (n == 0), 0).otherwise(F.greatest(F.lit(1), F.round(n / r))).cast("int")


def tokens(text: str, ratio: float = PROSE) -> int:
    n = len(" ".join(text.split()))
    return max(1, round(n / ratio)) if n else 0


#: What a cut costs after: an empty line, a line, a sentence, a clause, a word; inside a word.
PENALTY = {"block": 0.0, "line": 0.3, "sentence": 0.6, "clause": 1.5, "word": 2.5, "inside": 8.0}
_BOUNDARY = re.compile(r"(?P<block>\n[^\S\n]*\n\s*)|(?P<line>\n\s*)|(?<=[.!?])(?P<sentence>\s+)|(?<=[,;:])(?P<clause>\s+)|(?P<word>\s+)")
_GRID = 80
#: Characters by which an overlap may be longer than specified in order to begin at a word.
_WORD = 40


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a piece may end, with their penalties; 0 and the end included."""
    at, cost, last = [0], [0.0], 0
    spots = [(m.end(), PENALTY[m.lastgroup]) for m in _BOUNDARY.finditer(text)] + [(len(text), 0.0)]
    for p, c in spots:
        for q in range(last + _GRID, p, _GRID):
            at.append(q)
            cost.append(PENALTY["inside"])
        if p > at[-1]:
            at.append(p)
            cost.append(c)
        else:
            cost[-1] = min(cost[-1], c)
        last = p
    return np.array(at), np.array(cost)


def cut(text: str, room: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, body start, end) of each piece: text[body start:end] are consecutive and cover the text; start is where
    the piece overlaps the one before by `overlap` characters, moved left to the word's beginning. No piece has more than `room` normalised characters."""
    blank = np.fromiter((c.isspace() for c in text), bool, len(text))
    used = np.concatenate([[0], np.cumsum(~(blank & np.concatenate([[False], blank[:-1]])))])
    at, cost = boundaries(text)
    n = used[at]
    # where a piece that follows a cut starts
    exact = np.maximum(0, np.searchsorted(used, np.maximum(n - overlap, 0), "right") - 1)
    natural = at[cost < PENALTY["inside"]]
    word = natural[np.searchsorted(natural, exact, "right") - 1]
    start = np.where(used[exact] - used[word] <= _WORD, word, exact)
    lead = used[start]  # it never falls from one boundary to the next
    even = n[-1] / max(1, int(np.ceil((n[-1] - overlap) / max(1, room - overlap)))) if n[-1] > room else n[-1]
    best, prev = np.full(len(at), np.inf), np.zeros(len(at), int)
    best[0] = 0.0
    lo = 0
    for j in range(1, len(at)):
        while n[j] - lead[lo] > room:
            lo += 1
        i = np.arange(lo, j)
        # so what fits is a suffix of the earlier boundaries
        total = best[i] + ((n[j] - n[i] - even) / room) ** 2 * 4
        k = int(np.argmin(total))
        best[j], prev[j] = total[k] + cost[j], i[k]
    ends, j = [], len(at) - 1
    while j > 0:
        ends.append(j)
        j = int(prev[j])
    out, i = [], 0
    for j in reversed(ends):
        out.append((int(start[i]), int(at[i]), int(at[j])))
        i = j
    return out


PIECES = "record_kind string, doc_id long, item_no int, piece_no int, start_pos int, body_pos int, end_pos int, n_tokens int, trail_cut boolean, trail string, piece_text string"


def _trail_for(trail: str, limits: Limits) -> tuple[str, bool]:
    if tokens(trail) <= limits.max_tokens - limits.min_body:
        return trail, False
    parts = trail.split(" > ")
    while len(parts) > 1 and tokens(" > ".join(parts)) > limits.max_tokens - limits.min_body:
        parts = parts[1:]
    kept = " > ".join(parts)
    while tokens(kept) > limits.max_tokens - limits.min_body:
        kept = kept[-int((limits.max_tokens - limits.min_body) * PROSE) :]
    return kept, True


def split_items(items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """items: record_kind, doc_id, item_no, body, trail, is_code. Returns the pieces of those over the limit."""
    code = F.coalesce(F.col("is_code"), F.lit(False))
    size = token_count(F.col("body"), F.when(code, CODE).otherwise(PROSE)) + token_count(F.col("trail"))
    # a blank body has no piece that could fit better, whatever its trail
    over = items.select("record_kind", "doc_id", "item_no", "body", F.coalesce("trail", F.lit("")).alias("trail"), code.alias("is_code")).where((size > limits.max_tokens) & (token_count(F.col("body")) > 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                trail, shortened = _trail_for(r.trail, limits)
                ratio = CODE if r.is_code else PROSE
                left = limits.max_tokens - tokens(trail)
                # half a token less, so that rounding cannot pass the limit
                for k, (s, b, e) in enumerate(cut(r.body, int((left - 0.5) * ratio), int(limits.overlap * ratio))):
                    piece = r.body[s:e]
                    rows.append((r.record_kind, r.doc_id, r.item_no, k, s + 1, b + 1, e, tokens(piece, ratio) + tokens(trail), shortened, trail, piece))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"doc_id": "Int64", "item_no": "Int32", "trail_cut": bool})

    # few and long rows: spread them over all cores whichever file they came from
    return over.repartition(parallelism(items.sparkSession), "doc_id", "item_no").mapInPandas(run, PIECES)
