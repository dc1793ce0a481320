"""Word sequences and canonical forms, shared by the text operators.

A *word* is an unbroken run of letters or digits; case is folded and accents are composed (NFC) first.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
_LINE = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
#: a line ``Name: value``: a name without colon, a colon, white space and a value holding a letter or digit
_FIELD = re.compile(r"[^\w:]*[^\W_][^:]*:\s+.*[^\W_].*\Z")


def fold(text: str) -> str:
    """Composed accents and folded case."""
    if text.isascii():
        return text.lower()
    folded = unicodedata.normalize("NFC", text).casefold()
    return folded if unicodedata.is_normalized("NFC", folded) else unicodedata.normalize("NFC", folded)


def words(text: str | None) -> list[str]:
    return _WORD.findall(fold(text)) if text else []


def words_and_canonical(text: str | None) -> tuple[list[str], str]:
    """The words, and the text without what is only formatting.

    Words joined by one blank. Two or more opening lines ``Name: value`` are sorted, each ended by a line
    feed, since their order carries no meaning.
    """
    if not text:
        return [], ""
    text = fold(text)
    found = _WORD.findall(text)
    head, pos = [], 0
    if ":" in text:
        while True:
            m = _LINE.search(text, pos)
            line = text[pos : m.start()] if m else text[pos:]
            if not _FIELD.match(line):
                break
            head.append(_WORD.findall(line))
            pos = m.end() if m else len(text)
            if m is None:
                break
    if len(head) < 2:
        return found, " ".join(found)
    opening = sum(map(len, head))
    return found, "".join(" ".join(x) + "\n" for x in sorted(head)) + " ".join(found[opening:])


def canonical(text: str | None) -> tuple[str, int]:
    """The canonical text and its number of words."""
    found, key = words_and_canonical(text)
    return key, len(found)


@lru_cache(maxsize=1 << 18)
def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def hashes(found: list[str]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(word_hash, found), dtype=np.uint64, count=len(found))


_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (public SplitMix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words, by position; empty when there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for i in range(1, k):
            out *= _MULT
            out += h[i : i + n]
    return mix(out)
