"""Words, hashes and blanks, on the Python side of Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
MUL = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of any script, in lower case."""
    found = WORD.findall(text or "")
    return "\n".join(found).lower().split("\n") if found else []


class HashMemo(dict):
    """64-bit hash of a word, remembered for up to a million words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v

    def of(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) ^ (h >> np.uint64(32))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive elements; empty if there are fewer."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * MUL + h[j : j + m]
    return mix(out)


def char_windows(codes: np.ndarray, n: int) -> np.ndarray:
    """As windows(), for long n: by differences of a running polynomial modulo 2**64."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    power = np.cumprod(np.full(len(codes), MUL, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power)])
    # the inverse power makes the hash the same wherever the window stands
    return mix((total[n:] - total[:-n]) * np.cumprod(np.full(m, INVERSE, np.uint64)))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)
