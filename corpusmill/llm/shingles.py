"""Word n-gram sets as sorted 64-bit keys, built a batch of texts at a time with numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_CACHE: dict[str, int] = {}
#: Words whose hashes are kept; the cache is emptied beyond it, so memory is bounded.
CACHE_WORDS = 1_000_000
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


#: For ASCII texts: letters lower-cased, digits kept, all else a space.
_ASCII = {i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)}


def words(text: str) -> list[str]:
    """The longest runs of letters and digits of the lower-cased text."""
    return text.translate(_ASCII).split() if text.isascii() else WORD.findall(text.lower())


def places(text: str) -> list[tuple[int, int]]:
    """Where each of ``words(text)`` stands in the text itself, as [first, past the last character).

    Some characters become several when they're lower-cased; a word's place then covers them whole."""
    low = text.lower()
    found = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return found
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(origin[a], origin[b - 1] + 1) for a, b in found]


def _hashes(tokens: list[str]) -> list[int]:
    cache = _CACHE
    try:
        return [cache[w] for w in tokens]
    except KeyError:
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in tokens:
            if w not in cache:
                cache[w] = xxhash.xxh3_64_intdigest(w)
        return [cache[w] for w in tokens]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def batch(texts: list[str | None], n: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, hash) of every run of ``n`` words of the texts that have
    ``min_words`` words; repeats are kept. Null texts have none."""
    flat: list[int] = []
    docs: list[int] = []
    lengths: list[int] = []
    for i, text in enumerate(texts):
        if text is None:
            continue
        tokens = words(text)
        if len(tokens) >= max(min_words, n):
            flat += _hashes(tokens)
            docs.append(i)
            lengths.append(len(tokens))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = np.array(flat, dtype=np.uint64)
    doc = np.repeat(np.array(docs, np.int64), lengths)
    size = len(w) - n + 1
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h = _mix(h + w[k : k + size] * np.uint64(_MULTIPLIERS[k % len(_MULTIPLIERS)]))
    whole = doc[:size] == doc[n - 1 :]
    return doc[:size][whole], h[whole]


def distinct(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs sorted by text and key, each once; they come sorted by text."""
    if len(doc):
        key = key.copy()
        begin = starts(doc).tolist()
        for a, b in zip(begin, [*begin[1:], len(doc)]):
            key[a:b].sort()
        first = np.ones(len(doc), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        doc, key = doc[first], key[first]
    return doc, key


def starts(doc: np.ndarray) -> np.ndarray:
    """Where each text begins in an array sorted by text."""
    return np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
