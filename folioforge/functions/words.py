"""Vectorised word and shingle hashing over batches of texts (numpy, no per-word Python).

A word is a run of Unicode letters and digits, case ignored.  Texts are laid
end to end as code points; word boundaries, word hashes and shingle hashes come
out of a handful of array passes, so the cost is a few nanoseconds a character.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MULT = np.uint64(0xFF51AFD7ED558CCD)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer; uniform bits out of structured keys."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= _MULT
    x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case map and word-character mask, indexed by code point."""
    n = 0x110000
    low = np.arange(n, dtype=np.uint32)
    word = np.zeros(n, dtype=bool)
    for cp in range(0x20000):  # cased letters all lie in the first two planes
        c = chr(cp)
        word[cp] = c.isalnum()
        folded = c.lower()
        if len(folded) == 1:
            low[cp] = ord(folded)
    word[0x20000:0x323B0] = True  # further planes of ideographs
    return low, word


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    p = np.empty(256, dtype=np.uint64)
    x = 1
    for i in range(256):
        p[i] = x
        x = x * 0x100000001B3 % (1 << 64)
    return p


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and for each word the text it is in."""
    low, is_word = _tables()
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    joined = " ".join(texts) + " "
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))
    mask = is_word[cp]
    edge = np.diff(mask.view(np.int8), prepend=np.int8(0))
    begin = np.flatnonzero(edge == 1)
    end = np.flatnonzero(edge == -1)
    if begin.size == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    # positions of word characters only
    where = np.flatnonzero(mask)
    first = np.concatenate(([0], np.cumsum(end - begin)[:-1]))
    place = (where - np.repeat(begin, end - begin)) & 255
    value = (low[cp[where]].astype(np.uint64) + np.uint64(1)) * _powers()[place]
    hashes = mix64(np.add.reduceat(value, first) + (end - begin).astype(np.uint64) * _MIX)
    owner = np.searchsorted(starts, begin, side="right") - 1
    return hashes, owner


def shingle_sets(texts: Sequence[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingle hashes of each text.

    Returns ``(hashes, offsets, n_words)``: text ``i`` owns the sorted slice
    ``hashes[offsets[i]:offsets[i + 1]]``.
    """
    words, owner = word_hashes(texts)
    n_words = np.bincount(owner, minlength=len(texts)) if owner.size else np.zeros(len(texts), np.int64)
    n = words.size - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64), n_words
    h = words[:n].copy()
    for k in range(1, width):
        h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + words[k : n + k])
    inside = owner[:n] == owner[width - 1 :]
    h, who = h[inside], owner[:n][inside]
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    keep = np.ones(h.size, dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    h, who = h[keep], who[keep]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(texts)))))
    return h, offsets, n_words
