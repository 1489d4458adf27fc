"""Evaluation texts leaking into training text.

Every word is canonicalised: numbers, units and, for re-parameterised leaks, names (words that the held-out texts do not
have, or have as a name; words with a capital inside a sentence) become typed placeholders. Windows of 13 canonical words of documents and held-out texts are joined by
hash; the words that filled the placeholders, the slots, then decide: equal slots are a verbatim leak, a consistent
one-to-one substitution is a re-parameterised one.

Defined results: a document or case without an id is reported under null; null and empty texts and texts under 13 words leak nothing; repeated documents or cases count once
per id; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.words import WORD, HashMemo, mix, signed, windows, words
from passagework.workspace import materialise

WINDOW = 13
#: Fixed words for measures, in lower case.
UNITS = frozenset("seconds minute minutes hour hours day days week weeks month months quarter quarters year years credit credits percent copies kilometre kilometres metre metres litre litres gram grams kilogram kilograms byte bytes kb mb gb tb euro euros dollar dollars".split())
#: Fixed words for numbers, in lower case.
SPELLED = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred hundreds thousand thousands million millions billion billions dozen first second third fourth fifth sixth seventh eighth ninth tenth half twice".split())
NUMBER, NAME, UNIT = "\x01number", "\x01name", "\x01unit"
#: Held-out window hashes are sent to every executor up to this size, beyond it windows are shuffled.
MAX_BROADCAST_BYTES = 64 << 20
#: Words of the held-out texts that are sent to executors at most; beyond it those of few cases are joined.
MAX_NAMES = 1_000_000


def name_lexicon(cases: DataFrame, text: str = "body") -> DataFrame:
    """Words that inside a sentence of the held-out texts occur with a capital and never in lower case."""
    inner = F.explode(F.expr(rf"regexp_extract_all({text}, '(?<=[\\p{{L}}\\p{{N}},;] )(\\p{{L}}[\\p{{L}}\\p{{N}}]*)', 1)"))
    seen = cases.select(inner.alias("w")).select(F.lower("w").alias("word"), (F.col("w") != F.lower("w")).alias("capital"))
    return seen.groupBy("word").agg(F.min("capital").alias("always")).where("always").select("word")


def literal_words(held: DataFrame) -> DataFrame:
    """word, n: the words of the held-out texts that are no names, and the number of cases that have them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = {(i, w) for i, text in zip(pdf["id"], pdf["body"]) for w in words(text)}
            yield pd.DataFrame(list(pairs), columns=["id", "word"])

    seen = held.select("id", "body").mapInPandas(run, "id string, word string").groupBy("word").agg(F.count_distinct("id").alias("n"))
    return seen.join(name_lexicon(held), "word", "left_anti")


def split_literals(lexicon: DataFrame, most: int) -> tuple[list[frozenset[str]], DataFrame | None]:
    """Two choices of the words that stay as they are: those of literal_words(), and of these the ones that more than one case
    has, so that coined words of one case are slots too. Beyond `most` words the lists hold those that most cases have, and the
    others come as the second result, for joining."""
    least, total = None, 0
    for r in sorted(lexicon.groupBy("n").count().collect(), reverse=True):
        if (total := total + r["count"]) > most:
            break
        least = r.n
    rest = None
    if total > most:
        # words of one number of cases are sent all or none
        rest = lexicon if least is None else lexicon.where(F.col("n") < least)
        lexicon = lexicon.limit(0) if least is None else lexicon.where(F.col("n") >= least)
    found = lexicon.toPandas()
    return [frozenset(found["word"]), frozenset(found["word"][found["n"] > 1])], rest


def with_own_literals(texts: DataFrame, literals, rest: DataFrame, width: int) -> DataFrame:
    """texts with two columns, `own` and `own_common`: which words of `rest` a text has, and which of these more than one case
    has. Only words that `literals`, the lists sent, leave open travel, once a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = _Canon(literals.value[0])
        for pdf in batches:
            found = {body_id: {w for w in ws if canon[w] == NAME} for body_id, ws in ((b, words(t)) for b, t in zip(pdf["body_id"], pdf["body"])) if len(ws) >= width}
            yield pd.DataFrame([(b, w) for b, ws in found.items() for w in ws], columns=["body_id", "word"])

    open_words = texts.select("body_id", "body").mapInPandas(run, "body_id long, word string")
    own = open_words.join(rest, "word").groupBy("body_id").agg(F.collect_set("word").alias("own"), F.collect_set(F.when(F.col("n") > 1, F.col("word"))).alias("own_common"))
    return texts.join(own, "body_id", "left")


class _Canon(dict):
    """literal: the words that stay, all others being names; None keeps every word that is no number and no unit."""

    def __init__(self, literal: frozenset[str] | None = None):
        self.literal = literal

    def __missing__(self, w: str) -> str:
        if len(self) >= 1 << 20:
            self.clear()
        v = NUMBER if w in SPELLED or any(c.isdigit() for c in w) else UNIT if w in UNITS else w if self.literal is None or w in self.literal else NAME
        self[w] = v
        return v


#: template and slots: hashes of the canonical words and of the words in the slots, which together are the window.
KEYS = "id string, body_id long, pos int, template long, slots long"
SCHEMA = f"{KEYS}, filled array<string>"


def _template_windows(literals, keep, width: int, least_slots: int, most_slots: int, filled: bool):
    """literals: a set of literal words per way of writing templates, each also with words that have a capital inside a
    sentence as names; None for one way without names. A text may have further literal words of its own, a column per way. keep: sorted hashes of held-out windows, or None for all windows. filled: whether
    the words in the slots are given out too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = literals.value if literals is not None else None
        memo, canons = HashMemo(), [_Canon(x) for x in sets or [None]]
        wanted = keep.value if keep is not None else None
        number, name, unit = (np.uint64(memo[x]) for x in (NUMBER, NAME, UNIT))
        for pdf in batches:
            ids, own, pos, tem, slo, fil = [], [], [], [], [], []
            further = zip(pdf["own"], pdf["own_common"]) if "own" in pdf else repeat([None] * len(canons))
            for i, text, body_id, more in zip(pdf["id"], pdf["body"], pdf["body_id"], further):
                ws = words(text)
                if len(ws) < width:
                    continue
                ways = [memo.of([w if w in x else c[w] for w in ws] if x else [c[w] for w in ws]) for c, x in zip(canons, (m if m is None else frozenset(m) for m in more))]
                if sets is not None:
                    capital = inner_capitals(text)
                    ways += [np.where(capital & (h != number), name, h) for h in ways]
                seen = []
                for h in ways:
                    slot = (h == number) | (h == name) | (h == unit)
                    t = windows(h, width)
                    n = np.convolve(slot, np.ones(width, np.int64), "valid")
                    ok = (n >= least_slots) & (n <= most_slots)
                    for other in seen:
                        ok &= t != other
                    seen.append(t)
                    hit = np.flatnonzero(ok)
                    if wanted is not None:
                        k = np.searchsorted(wanted, t[hit])
                        hit = hit[wanted[np.minimum(k, len(wanted) - 1)] == t[hit]] if len(wanted) else ()
                    for p in hit:
                        here = [w for w, s in zip(ws[p : p + width], slot[p : p + width]) if s]
                        ids.append(i)
                        own.append(body_id)
                        pos.append(p)
                        tem.append(t[p])
                        slo.append(np.uint64(hash_words(here, memo)))
                        if filled:
                            fil.append(here)
            if ids:  # an empty column of lists has no type
                out = pd.DataFrame({"id": ids, "body_id": np.array(own, np.int64), "pos": np.array(pos, np.int32), "template": signed(np.array(tem, np.uint64)), "slots": signed(np.array(slo, np.uint64))})
                yield out.assign(filled=fil) if filled else out

    return run


_RUN = re.compile(r"([^\W_]+)([\W_]*)")


def inner_capitals(text: str) -> np.ndarray:
    """For each word, whether it begins with a capital inside a sentence."""
    found = _RUN.findall(text)
    before = [""] + [gap for _, gap in found]
    return np.fromiter((w[0].isupper() and gap in (" ", ", ", "; ") for (w, _), gap in zip(found, before)), bool, len(found))


def hash_words(ws: list[str], memo: HashMemo) -> int:
    h = 0
    for w in ws:
        h = (h * 0x9E3779B97F4A7C15 + memo[w] + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def held_out_texts(cases: DataFrame) -> DataFrame:
    """case_id with each of its question and passage."""
    return cases.select(F.col("case_id").cast("string").alias("id"), F.explode(F.array("question", "passage")).alias("body")).where("body is not null")


def template_matches(documents: DataFrame, cases: DataFrame, width: int = WINDOW, max_broadcast: int = MAX_BROADCAST_BYTES, names: bool = False, least_slots: int = 0, most_slots: int = WINDOW, filled: bool = False) -> tuple[DataFrame, DataFrame]:
    """Windows of held-out texts and windows of documents that may match them. documents: doc_id, text. With `names` every
    word that the held-out texts do not have is a name, whatever its case and place, so a copy with new names meets its
    original; beyond MAX_NAMES words the rarer ones are joined to the texts that have them, with the same result."""
    spark = documents.sparkSession
    held = held_out_texts(cases).withColumn("body_id", F.xxhash64("body"))
    docs = documents.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"), F.xxhash64("text").alias("body_id")).where("text is not null")
    literals = None
    if names:
        # written once: it is counted, sent and joined
        sent, rest = split_literals(materialise(literal_words(held), "leak-words"), MAX_NAMES)
        literals = spark.sparkContext.broadcast(sent)
        if rest is not None:
            held, docs = (with_own_literals(x, literals, rest, width) for x in (held, docs))
    make = lambda keep: _template_windows(literals, keep, width, least_slots, most_slots, filled)
    # written once: it is counted, sent and joined
    theirs = materialise(held.mapInPandas(make(None), SCHEMA if filled else KEYS), "leak-held-out")
    count = theirs.agg(F.approx_count_distinct("template")).first()[0]
    keep = None
    if count * 8 * 1.2 <= max_broadcast:
        hashes = theirs.select("template").distinct().toPandas()["template"].to_numpy(np.int64)
        keep = spark.sparkContext.broadcast(np.sort(hashes.view(np.uint64)))
    mine = docs.mapInPandas(make(keep), SCHEMA if filled else KEYS)
    return theirs, mine


def verbatim_leaks(documents: DataFrame, cases: DataFrame, width: int = WINDOW) -> DataFrame:
    """case_id, doc_id, n_windows: documents with `width` consecutive words of a case, word for word: the same template
    and, checked with it, the same words in its slots, as two 64-bit hashes. No words travel."""
    theirs, mine = template_matches(documents, cases, width)
    c = theirs.select(F.col("id").alias("case_id"), "template", "slots").distinct()
    joined = mine.select(F.col("id").cast("long").alias("doc_id"), "template", "slots").join(c, ["template", "slots"])
    return joined.groupBy("case_id", "doc_id").agg(F.count(F.lit(1)).alias("n_windows"))


def reparameterised_leaks(documents: DataFrame, cases: DataFrame, width: int = WINDOW, min_fixed: int = 7) -> DataFrame:
    """case_id, doc_id, n_windows, sample_case, sample_doc: the same template with other numbers, names or units, put in
    consistently: a slot value of the case always becomes the same value of the document and the other way round.
    n_windows: windows of the document. Windows with fewer than `min_fixed` words outside the slots prove nothing."""
    theirs, mine = template_matches(documents, cases, width, names=True, least_slots=1, most_slots=width - min_fixed, filled=True)
    c = theirs.select(F.col("id").alias("case_id"), "template", F.col("slots").alias("case_slots"), F.col("filled").alias("case_filled")).dropDuplicates(["case_id", "template", "case_slots"])
    d = mine.select(F.col("id").cast("long").alias("doc_id"), "template", "slots", F.col("filled").alias("doc_filled"), F.col("body_id").alias("doc_body"), F.col("pos").alias("doc_pos"))
    joined = d.join(c, "template").where("slots <> case_slots")
    pairs = F.array_distinct(F.arrays_zip("case_filled", "doc_filled"))
    consistent = (F.size(pairs) == F.size(F.array_distinct("case_filled"))) & (F.size(pairs) == F.size(F.array_distinct("doc_filled")))
    return joined.where(consistent).groupBy("case_id", "doc_id").agg(F.count_distinct("doc_body", "doc_pos").alias("n_windows"), F.min(F.array_join("case_filled", " ")).alias("sample_case"), F.min(F.array_join("doc_filled", " ")).alias("sample_doc"))
