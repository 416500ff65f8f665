"""Query-focused snippets: the window with the most distinct query words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..models import chunk_spans

LONGEST = 230


def best_window(text: str, words: list[str], longest: int = LONGEST) -> str:
    """At most ``longest`` characters holding the most distinct words, earliest on ties; the beginning without a hit."""
    if len(text) <= longest:
        return text
    if not words:
        return text[:longest]
    hits = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(rf"(?i)(?<!\w)(?:{'|'.join(map(re.escape, words))})(?!\w)", text)]
    best, at, left = 0, None, 0
    count: dict[str, int] = {}
    for start, end, w in hits:
        count[w] = count.get(w, 0) + 1
        while end - hits[left][0] > longest:
            gone = hits[left][2]
            count[gone] -= 1
            if not count[gone]:
                del count[gone]
            left += 1
        if len(count) > best:
            best, at = len(count), hits[left][0]
    if at is None:
        return text[:longest]
    start = max(0, min(at - 40, len(text) - longest))
    if start:  # begin at a word
        nxt = text.find(" ", start, at)
        start = nxt + 1 if nxt >= 0 else at
    return text[start : start + longest]


def windows(text: str, words: list[str], longest: int = LONGEST, parts: int = 2) -> str:
    """Up to ``parts`` windows of different words, together at most ``longest`` characters."""
    share, left, out = longest // parts, list(words), []
    for _ in range(parts):
        w = best_window(text, left, share)
        hit = [x for x in left if re.search(rf"(?i)(?<!\w){re.escape(x)}(?!\w)", w)]
        if out and not hit:
            break
        out.append(w)
        left = [x for x in left if x not in hit]
        if not left:
            break
    return " … ".join(out)


def chunk_window(text: str, words: list[str], longest: int, chunk: int) -> str:
    """The best window of the chunk that answered the query; the chunk's beginning where it holds none of the words."""
    spans = chunk_spans(text)
    if not spans:
        return best_window(text, words, longest)
    a, b = spans[min(chunk, len(spans) - 1)]
    return best_window(text[a:b], words, longest)


def snippet_column(text: str, words: list[str], longest: int = LONGEST, style: str = "querybest", chunk_col: str | None = None) -> Column:
    """Snippet of a text column ("querybest": one window, "querymultiple": several); use it on rows that are already limited.

    ``chunk_col`` names the chunk that made the row an answer by its vector: it
    seeds the snippet where the whole text holds none of the words.
    """
    if style not in ("querybest", "querymultiple"):
        raise ValueError("style must be querybest or querymultiple")
    cut = best_window if style == "querybest" else windows
    any_word = re.compile(rf"(?i)(?<!\w)(?:{'|'.join(map(re.escape, words))})(?!\w)") if words else None

    def one(t, chunk) -> str | None:
        if t is None:
            return None
        if chunk is not None and not pd.isna(chunk) and not (any_word and any_word.search(t)):
            return chunk_window(t, words, longest, int(chunk))
        return cut(t, words, longest)

    if chunk_col is None:

        @F.pandas_udf("string")
        def make(s: pd.Series) -> pd.Series:
            return s.map(lambda t: one(t, None))

        return make(F.col(text))

    @F.pandas_udf("string")
    def seeded(s: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([one(t, k) for t, k in zip(s, c)])

    return seeded(F.col(text), F.col(chunk_col))
