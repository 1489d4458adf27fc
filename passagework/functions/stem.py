"""English stems by suffix rules in the spirit of Porter's published algorithm, as an Arrow function over words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWEL = re.compile(r"[aeiouy]")
#: Fixed values of the published algorithm: endings with what replaces them where the rest is long enough.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    return c not in "aeiou" and not (c == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    """How often vowels are followed by consonants."""
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _short_end(w: str) -> bool:
    n = len(w)
    return n >= 3 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


def _swap(w: str, table: dict[str, str], least: int) -> str:
    for end in sorted(table, key=len, reverse=True):
        if w.endswith(end):
            head = w[: -len(end)]
            return head + table[end] if _measure(head) > least else w
    return w


def stem(w: str) -> str:
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(w, _STEP2, 0)
    w = _swap(w, _STEP3, 0)
    for end in _STEP4:
        if w.endswith(end):
            w = w[: -len(end)] if _measure(w[: -len(end)]) > 1 else w
            break
    else:
        if w.endswith(("sion", "tion")) and _measure(w[:-3]) > 1:
            w = w[:-3]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


_WORD = re.compile(r"[^\W_]+")


@F.pandas_udf(T.StringType())
def _stemmed(texts: pd.Series) -> pd.Series:
    memo: dict[str, str] = {}

    def one(text):
        if text is None:
            return None
        out = []
        for w in _WORD.findall(text.lower()):
            if w not in memo:
                memo[w] = stem(w)
            out.append(memo[w])
        return " ".join(out)

    return texts.map(one)


def stemmed(text: Column) -> Column:
    """The words of a text as stems, blanks between them; null for null."""
    return F.when(text.isNotNull(), _stemmed(text))
