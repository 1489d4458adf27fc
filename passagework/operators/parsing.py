"""Documents to blocks: markdown, plain text, word processor files and the lines of a page layout.

Scanners run once per document in Arrow batches; everything that is a rule over neighbouring rows (heading trails, page
layout) is a window over the blocks instead.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import text as tx

KINDS = ("heading", "paragraph", "list", "code", "table", "quote", "rule")


@dataclass
class Block:
    kind: str
    text: str
    first: int  # line numbers, from 1
    last: int
    level: int | None = None
    lang: str | None = None
    path: tuple[str, ...] = ()

    @property
    def is_heading(self) -> bool:
        return self.kind == "heading"

    @property
    def is_atomic(self) -> bool:
        return self.kind in ("code", "table")

    @property
    def trail(self) -> str:
        return " > ".join(self.path)


class UnsupportedFile(ValueError):
    pass


# --- markdown -----------------------------------------------------------------------------------------------------------

_FENCE = re.compile(r" {0,3}(?P<run>`{3,}|~{3,})(?P<info>[^`]*)$")
_ATX = re.compile(r" {0,3}(?P<marks>#{1,6})[ \t]+(?P<text>.*?)(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_TABLE = re.compile(r"\s*\|")
_QUOTE = re.compile(r"\s{0,3}>")
_ITEM = re.compile(r"\s*(?:[-*+]|\d{1,9}[.)])[ \t]+\S")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")


def _kind(line: str) -> str:
    """What a line opens; the order is the precedence."""
    if not line.strip():
        return "blank"
    for kind, pattern in (("fence", _FENCE), ("heading", _ATX), ("rule", _RULE), ("table", _TABLE), ("quote", _QUOTE), ("list", _ITEM)):
        if pattern.match(line):
            return kind
    return "paragraph"


def _fence_end(lines: list[str], at: int) -> int:
    """The line that closes the fence opened at `at`; the number of lines if none does."""
    run = _FENCE.match(lines[at])["run"]
    for i in range(at + 1, len(lines)):
        s = lines[i].strip()
        if len(s) >= len(run) and not s.strip(run[0]):
            return i
    return len(lines)


def _list_end(lines: list[str], at: int) -> int:
    i = at + 1
    while i < len(lines):
        kind = _kind(lines[i])
        if kind in ("heading", "fence"):
            break
        if kind == "blank":
            ahead = next((j for j in range(i, len(lines)) if lines[j].strip()), None)
            if ahead is None or not (_ITEM.match(lines[ahead]) or lines[ahead].startswith(("  ", "\t"))) or _kind(lines[ahead]) in ("heading", "fence"):
                break
            i = ahead
        else:
            i += 1
    return i


def markdown_blocks(raw: str) -> list[Block]:
    lines, out, i = raw.splitlines(), [], 0
    add = lambda kind, text, end, **more: out.append(Block(kind, text, i + 1, end, **more))
    while i < len(lines):
        kind, end = _kind(lines[i]), i + 1
        if kind == "fence":
            close = _fence_end(lines, i)
            info = _FENCE.match(lines[i])["info"].split()
            end = min(close + 1, len(lines))
            add("code", "\n".join(lines[i + 1 : close]), end, lang=info[0] if info else None)
        elif kind == "heading":
            m = _ATX.match(lines[i])
            add("heading", m["text"].strip(), end, level=len(m["marks"]))
        elif kind == "rule":
            add("rule", lines[i].strip(), end)
        elif kind in ("table", "quote"):
            same = _TABLE if kind == "table" else _QUOTE
            while end < len(lines) and same.match(lines[end]):
                end += 1
            part = lines[i:end]
            text = "\n".join(x.strip() for x in part) if kind == "table" else "\n".join(re.sub(r"^\s*>[ ]?", "", x) for x in part).strip()
            add(kind, text, end)
        elif kind == "list":
            end = _list_end(lines, i)
            add("list", "\n".join(lines[i:end]).rstrip(), end)
        elif kind == "paragraph":
            level = None
            while end < len(lines):
                m = _UNDERLINE.match(lines[end])
                if m:
                    level, end = 1 if m[1][0] == "=" else 2, end + 1
                    break
                if _kind(lines[end]) in ("blank", "heading", "fence", "table", "list"):
                    break
                end += 1
            text = " ".join(x.strip() for x in lines[i : end - (level is not None)])
            add("heading" if level else "paragraph", text, end, level=level)
        i = end
    return with_paths(out)


# --- plain text ---------------------------------------------------------------------------------------------------------

_TEXT_UNDERLINE = re.compile(r"\s*([-=_*])\1{2,}\s*$")


def looks_like_heading(line: str) -> bool:
    """Short, in capitals, no closing punctuation, not an item."""
    s = line.strip()
    return bool(s) and len(s) <= 72 and any(c.isalpha() for c in s) and s == s.upper() and s[-1] not in ".,;:!?" and not _ITEM.match(line)


def text_blocks(raw: str) -> list[Block]:
    lines, out, i = raw.splitlines(), [], 0
    while i < len(lines):
        if not lines[i].strip():
            i += 1
            continue
        if looks_like_heading(lines[i]):
            end = i + 2 if i + 1 < len(lines) and _TEXT_UNDERLINE.match(lines[i + 1]) else i + 1
            out.append(Block("heading", lines[i].strip(), i + 1, end, level=2))
        else:
            end = i + 1
            while end < len(lines) and lines[end].strip() and not looks_like_heading(lines[end]):
                end += 1
            out.append(Block("paragraph", "\n".join(x.rstrip() for x in lines[i:end]).strip(), i + 1, end))
        i = end
    return with_paths(out)


# --- word processor files -----------------------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(content: bytes) -> list[Block]:
    """Body order; headings by style, list styles, tables as rows between bars. Read with the standard library."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise UnsupportedFile("not a word processor file") from e
    out = []
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    for n, e in enumerate(body if body is not None else [], 1):
        if e.tag == f"{_W}tbl":
            rows = ["| " + " | ".join(said(c) for c in r.iter(f"{_W}tc")) + " |" for r in e.iter(f"{_W}tr")]
            if len(rows) > 1:
                rows.insert(1, "|" + " --- |" * (rows[0].count("|") - 1))
            out.append(Block("table", "\n".join(rows), n, n))
        elif e.tag == f"{_W}p" and (text := said(e)):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") if style is not None else "").lower().replace(" ", "")
            if m := re.fullmatch(r"heading([1-9])", name):
                out.append(Block("heading", text, n, n, level=int(m[1])))
            elif name == "title":
                out.append(Block("heading", text, n, n, level=1))
            else:
                out.append(Block("list" if name.startswith("list") else "paragraph", text, n, n))
    return with_paths(out)


# --- trails, titles, routing --------------------------------------------------------------------------------------------


def with_paths(blocks: list[Block]) -> list[Block]:
    """The headings above each block, itself included: a heading ends all of its level or deeper."""
    open_: list[tuple[int, str]] = []
    for b in blocks:
        if b.is_heading:
            open_ = [*(x for x in open_ if x[0] < (b.level or 1)), (b.level or 1, b.text)]
        b.path = tuple(t for _, t in open_)
    return blocks


def decode(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def parse(content: bytes, kind: str | None) -> list[Block]:
    if kind == "docx":
        return docx_blocks(content)
    if kind == "markdown":
        return markdown_blocks(content.decode("utf-8"))
    if kind == "txt":
        return text_blocks(decode(content))
    raise UnsupportedFile(f"{kind or 'unknown type'}; supported: markdown, txt, docx")


def title_of(blocks: list[Block], fallback: str) -> str:
    heads = [b for b in blocks if b.is_heading]
    return next((b.text for b in heads if b.level == 1), heads[0].text if heads else fallback)


BLOCKS = "block_pos int, block_type string, block_text string, block_level int, code_lang string, line_start int, line_end int, heading_path array<string>"


def parse_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", kind: str | Column = "markdown") -> DataFrame:
    """documents with a text column: key, blocks. A document that cannot be parsed gives one row with `error` set and
    null positions; the others go on."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    key_type = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t, kd in zip(pdf["k"].tolist(), pdf["t"].tolist(), pdf["kind"].tolist()):
                try:
                    found = parse(bytes(t) if isinstance(t, (bytes, bytearray)) else t.encode("utf-8", "surrogatepass"), kd)
                    rows += [(i, n, b.kind, b.text, b.level, b.lang, b.first, b.last, list(b.path), None) for n, b in enumerate(found)]
                except ValueError as e:
                    rows.append((i, None, None, None, None, None, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=[key, *(c.split()[0] for c in BLOCKS.split(", ")), "error"])
            for c in ("block_pos", "block_level", "line_start", "line_end"):
                out[c] = out[c].astype("Int32")
            yield out

    return documents.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), k.alias("kind")).mapInPandas(run, f"{key} {key_type}, {BLOCKS}, error string")


def heading_paths(blocks: DataFrame, key: str = "doc_id", order: str = "block_pos", deepest: int = 9) -> DataFrame:
    """The same trails as with_paths, as windows: the last heading of each level counts while no heading of a lower level
    came after it. One sort per document, all levels in one pass."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.when(F.col("block_type") == "heading", F.coalesce("block_level", F.lit(1)))
    last = {n: F.max(F.when(level == n, F.struct(order, "block_text"))).over(w) for n in range(1, deepest + 1)}
    df = blocks.select("*", *(c.alias(f"_h{n}") for n, c in last.items()))
    keep = []
    for n in range(1, deepest + 1):
        above = F.greatest(F.lit(-1), *(F.coalesce(F.col(f"_h{m}")[order], F.lit(-1)) for m in range(1, n)), F.lit(-1))
        keep.append(F.when(F.col(f"_h{n}")[order] > above, F.col(f"_h{n}")["block_text"]))
    return df.withColumn("trail", F.array_compact(F.array(*keep))).drop(*(f"_h{n}" for n in last))


def layout_blocks(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """lines: key, line_no, page, size, top, text. The body size is the one most characters have (the first of equals);
    lines at least 1.5 larger are headings, the more the higher; paragraphs end at a page, at a wide gap, at a heading."""
    per = lines.groupBy(key, "size").agg(F.sum(F.length("text")).alias("chars"), F.min("line_no").alias("seen"))
    body = per.groupBy(key).agg(F.max_by("size", F.struct("chars", -F.col("seen"))).alias("body"))
    w = Window.partitionBy(key).orderBy("line_no")
    df = lines.join(body, key).withColumn("larger", F.col("size") - F.col("body"))
    df = df.withColumn("heading", F.col("larger") >= 1.5).withColumn("level", F.when(F.col("heading"), F.greatest(F.lit(1), F.least(F.lit(6), 4 - F.floor(F.col("larger") / 2.5)))).cast("int"))
    gap = F.col("top") - F.lag("top").over(w)
    starts = F.lag("line_no").over(w).isNull() | F.col("heading") | F.lag("heading").over(w) | (F.col("page") != F.lag("page").over(w)) | (gap > 1.6 * F.col("size"))
    df = df.withColumn("block_pos", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"])
    return df.groupBy(key, "block_pos").agg(F.first("heading").alias("heading"), F.first("level").alias("block_level"), F.min("page").alias("page"), F.array_join(parts, " ").alias("block_text")).select(key, "block_pos", F.when(F.col("heading"), "heading").otherwise("paragraph").alias("block_type"), "block_level", "page", "block_text")
