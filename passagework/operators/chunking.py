"""Blocks to chunks that fit a token ceiling together with their heading trail."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.functions.text import CODE_RATIO, PROSE_RATIO
from passagework.operators.parsing import Block


@dataclass(frozen=True)
class ChunkLimits:
    target: int = 450
    most: int = 700
    overlap: int = 60
    stub: int = 40
    break_level: int = 2
    margin: int = 32


def count_tokens(text: str, code: bool = False) -> int:
    n = len(" ".join(text.split()))
    return max(1, round(n / (CODE_RATIO if code else PROSE_RATIO))) if n else 0


def rendered(b: Block) -> str:
    if b.kind == "code":
        return f"```{b.lang or ''}\n{b.text}\n```"
    return f"{'#' * (b.level or 1)} {b.text}" if b.is_heading else b.text


@dataclass
class Chunk:
    text: str
    path: tuple[str, ...]
    tokens: int
    first: int
    last: int
    split: bool = False
    overlapped: bool = False
    blocks: list[Block] = field(default_factory=list, repr=False)


_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z\[(\"'])")


def _cost(b: Block) -> int:
    return count_tokens(b.text, b.kind == "code")


def _fill(parts: list[str], joint: str, room: int, code: bool) -> list[str]:
    """Neighbouring parts put together as long as they fit."""
    out: list[str] = []
    for p in parts:
        if out and count_tokens(out[-1] + joint + p, code) <= room:
            out[-1] += joint + p
        else:
            out.append(p)
    return out


def _by_words(text: str, room: int, code: bool) -> list[str]:
    words = text.split()
    longest = max(1, int((room - 0.5) * (CODE_RATIO if code else PROSE_RATIO)))
    whole = [w[i : i + longest] for w in words for i in range(0, len(w), longest)]
    return _fill(whole, " ", room, code)


def fragments(b: Block, ceiling: int, limits: ChunkLimits) -> list[Block]:
    """Pieces of a block over the ceiling: lines of code and tables, sentences of prose, words where those are too long.
    Every piece of a table begins with its two header lines."""
    code, room = b.kind == "code", max(1, ceiling - limits.margin)
    head: list[str] = []
    if b.is_atomic:
        parts, joint = b.text.split("\n"), "\n"
        if b.kind == "table" and len(parts) > 2:
            head = parts[:2]
            left = room - count_tokens("\n".join(head))
            parts, room, head = (parts[2:], left, head) if left > room // 4 else (parts, room, [])
    else:
        parts, joint = _SENTENCE.split(b.text), " "
    small = [q for p in parts for q in ([p] if count_tokens(p, code) <= room else _by_words(p, room, code))]
    texts = ["\n".join([*head, t]) if head else t for t in _fill(small, joint, room, code)]
    return [Block(b.kind, t, b.first, b.last, b.level, b.lang, b.path) for t in texts]


class Packer:
    def __init__(self, limits: ChunkLimits):
        self.limits, self.out = limits, []
        self.buffer: list[Block] = []
        self.carried = 0

    def _trail_cost(self, path: tuple[str, ...]) -> int:
        return count_tokens(" > ".join(path)) + 2 if path else 0

    def ceiling(self, b: Block) -> int:
        return max(1, self.limits.most - self._trail_cost(b.path))

    def held(self) -> int:
        return sum(map(_cost, self.buffer))

    def emit(self, blocks: list[Block], carried: int = 0, split: bool = False) -> None:
        own = blocks[carried:]
        path = next((b.path for b in own if not b.is_heading), own[-1].path)
        text = "\n\n".join(rendered(b) for b in blocks).strip()
        self.out.append(Chunk(text, path, sum(map(_cost, blocks)) + self._trail_cost(path), min(b.first for b in blocks), max(b.last for b in blocks), split, carried > 0, blocks))

    def flush(self, overlap: int) -> None:
        """Emits the buffer unless it is headings only, which wait for what follows, or overlap only, which is dropped."""
        own = self.buffer[self.carried :]
        if not own:
            self.buffer, self.carried = [], 0
            return
        if all(b.is_heading for b in own):
            self.buffer, self.carried = own, 0
            return
        whole = self.buffer
        self.emit(whole, self.carried)
        tail: list[Block] = []
        for b in reversed(whole):
            if overlap <= 0 or b.is_heading or b.is_atomic or sum(map(_cost, tail)) + _cost(b) > overlap:
                break
            tail.insert(0, b)
        self.buffer, self.carried = tail, len(tail)

    def run(self, blocks: list[Block]) -> list[Chunk]:
        lim = self.limits
        for b in blocks:
            if b.kind == "rule" or not b.text.strip():
                continue
            if b.is_heading and (b.level or 1) <= lim.break_level and self.buffer:
                self.flush(0)
            ceiling = self.ceiling(b)
            if _cost(b) > ceiling:
                self.flush(0)
                waiting, self.buffer, self.carried = self.buffer, [], 0
                for n, piece in enumerate(fragments(b, ceiling, lim)):
                    self.emit([*waiting, piece] if n == 0 else [piece], split=True)
                continue
            if self.buffer and self.held() + _cost(b) > ceiling:
                self.flush(min(lim.overlap, ceiling - _cost(b)))
            self.buffer.append(b)
            if self.held() >= lim.target:
                self.flush(lim.overlap)
        if self.buffer[self.carried :]:
            self.emit(self.buffer, self.carried)
        return self._merge_stub()

    def _merge_stub(self) -> list[Chunk]:
        if len(self.out) > 1:
            a, b = self.out[-2:]
            own = b.tokens - self._trail_cost(b.path)
            if b.tokens < self.limits.stub and a.path[:1] == b.path[:1] and a.tokens + own <= self.limits.most:
                self.out[-2:] = [Chunk(a.text + "\n\n" + b.text, a.path, a.tokens + own, min(a.first, b.first), max(a.last, b.last), a.split or b.split, a.overlapped, a.blocks + b.blocks)]
        return self.out


def pack_blocks(blocks: list[Block], limits: ChunkLimits = ChunkLimits()) -> list[Chunk]:
    return Packer(limits).run(blocks)


CHUNKS = "chunk_index int, section_path string, content string, token_count int, line_start int, line_end int, is_split boolean, has_overlap boolean"


def chunk_documents(documents: DataFrame, limits: ChunkLimits = ChunkLimits(), key: str = "doc_id", text: str = "text", kind: str = "markdown") -> DataFrame:
    """key and chunks of every document; a document is one row, so it is parsed and packed where it is read."""
    from passagework.operators.parsing import parse

    key_type = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, " > ".join(c.path), c.text, c.tokens, c.first, c.last, c.split, c.overlapped) for i, t in zip(pdf["k"].tolist(), pdf["t"].tolist()) for n, c in enumerate(pack_blocks(parse(t.encode("utf-8", "surrogatepass"), kind), limits))]
            yield pd.DataFrame(rows, columns=[key, *(c.split()[0] for c in CHUNKS.split(", "))])

    return documents.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {key_type}, {CHUNKS}")


def chunk_stats(chunks: DataFrame, limits: ChunkLimits = ChunkLimits(), tokens: str = "token_count") -> DataFrame:
    return chunks.agg(
        F.countDistinct("doc_id").alias("n_documents"), F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(tokens), 4).alias("mean_tokens"), F.expr(f"percentile({tokens}, 0.5)").alias("median_tokens"),
        F.min(tokens).alias("min_tokens"), F.max(tokens).alias("max_tokens"), F.count_if(F.col(tokens) > limits.most).alias("n_over"), F.count_if(F.col(tokens) < limits.stub).alias("n_stubs"),
    )


def token_histogram(chunks: DataFrame, tokens: str = "token_count") -> DataFrame:
    """bucket (its lower edge, in hundreds to 700), n."""
    return chunks.where(F.col(tokens) < 10_000).groupBy((F.least(F.floor(F.col(tokens) / 100), F.lit(7)) * 100).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
