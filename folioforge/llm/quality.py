"""Text quality statistics and text types from noisy threshold rules.

One Arrow pass gives the statistics of a document.  Thirteen thresholds on them
are labelling functions: each fires or abstains and votes for one type (prose,
list, table, junk).  Their accuracies are not set by hand: expectation
maximisation on the agreements of the functions over *all* documents estimates
how often each fires on each type.  It needs only the counts of the firing
patterns (at most 2^13 rows, however many documents), and gives each pattern,
hence each document, the posterior of every type.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import materialize, pick, spread
from .residue import Trusted

TYPES = ["prose", "list", "table", "junk"]
COMMON = set("the of and a to in is was it for on with as by that at from an be are this which or had its not but has were he his they have been who will would their there one all also after when into no some than more other about only then".split())
_LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_WORDS = re.compile(r"[^\W\d_]+")
_BULLET = re.compile(r"^\s*(?:[-*+•·‣–◦▪]\s+|\(?\d{1,4}[.)]\s+|[a-zA-Z][.)]\s+)\S")
_TERM_YEAR = re.compile(r"^.{2,60}\(\d{3,4}\)\s*$")
_DEFINED = re.compile(r"^[^.!?]{2,50}\s[–—-]\s[^.!?]{2,80}$")
_QUOTED = re.compile(r"“[^”]+”")
_PLACE = re.compile(r"\b(?:vol|no|pp?)\.\s*\d")
_BOOK = re.compile(r"\bISBN\b|\bpp\.\s*\d")
_KEY_VALUE = re.compile(r"^[A-Z][\w ./-]{1,24}?(?:\s*[:=]\s|\t)\s*\S.{0,48}$")
_COLUMNS = re.compile(r"\s*(?:\|\||\||;|\t)\s*|(?<=\S) {2,}(?=\S)")
_CELL = re.compile(r"^\W*(?:n/?a|[-–—?]|[+-]?[\d.,:/]+\s*(?:%|[a-z]{1,3}\d?)?|\d+\s*[–-]\s*\d+)\W*$", re.I)
_STYLE = re.compile(r"[\w-]+\s*[:=]\s*\"?#?[\w.%-]+\"?\s*[;}|/>]|\b(?:colspan|rowspan|bgcolor|cellpadding|align|style|class)=\"")
_BROKEN = re.compile(r"Ã[\x80-\xbfĀ-˿‚ƒ]|Ã.|Â.|â€.|ï¿½|Ð[\x80-\xbf°µ]|[�\x00-\x08\x0e-\x1f\u200b\xad]")
_VOWEL = re.compile(r"[aeiouyáéíóúàèìòùäöüâêîôûāēīōūãõåæø]", re.I)
_SEPARATED = re.compile(r"[;·•|]\s|,\s")
_SEPARATOR = re.compile(r"[;·•,]\s")
_CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f]")


def fold(text: str) -> str:
    """Text without accents, so that accented spellings of common words count."""
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


STATS = ["n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "n_lines", "line_end_share", "common_share", "prose_share", "list_share", "table_share", "junk_share", "repeat_share", "broken_share", "odd_word_share", "separator_rate", "cell_share"]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: 0 blank, 1 letter, 2 digit, 3 ordinary mark, 4 symbol."""
    t = np.full(0x110000, 4, np.uint8)
    for cp in range(0x30000):
        c = chr(cp)
        t[cp] = 0 if c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 4
    for c in ".,;:!?'\"()-–—“”’":
        t[ord(c)] = 3
    return t


class _Odd(dict):
    """Whether a word looks like no language: remembered, as words recur."""

    def __missing__(self, w: str) -> bool:
        odd = len(w) > 22 or (len(w) > 2 and not _VOWEL.search(w)) or bool(_CLUSTER.search(w))
        if len(self) < 500_000:
            self[w] = odd
        return odd


_ODD = _Odd()


def text_statistics(text: str) -> dict[str, float]:
    """Statistics of one whole text; a blank text has zeros."""
    s = dict.fromkeys(STATS, 0.0)
    lines = [x for x in (raw.strip() for raw in _LINES.split(text)) if x]
    if not lines:
        return s
    chars = sum(map(len, lines))
    ascii_ = text.isascii()
    count = np.bincount(_classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=5)
    solid = int(count[1:].sum())
    s["digit_ratio"], s["symbol_ratio"] = count[2] / solid, count[4] / solid
    broken = 0
    if not ascii_ or _CONTROL.search(text):
        broken = sum(len(m) for m in _BROKEN.findall(text))
    s["broken_share"] = broken / solid
    ended = share_p = share_l = share_t = share_j = cells = short = n = common_all = 0
    words: list[str] = []
    for line in lines:
        k = len(line)
        low = _WORDS.findall(line.lower() if ascii_ else fold(line).lower())
        words += low
        m = len(low)
        n += m
        common = sum(map(COMMON.__contains__, low))
        common_all += common
        closed = line[-1] in ".!?”\"…)"
        if closed or line[-1] == ":":
            ended += k
        if broken and len(_BROKEN.findall(line)) * 50 >= k:
            share_j += k
        elif closed and m >= 5 and common >= 0.18 * m and line[0].isalpha() and "“" not in line and "|" not in line and "=" not in line:
            share_p += k
        elif _CELL.match(line):
            cells += 1
            share_t += k
        elif _is_reference(line) or _TERM_YEAR.match(line) or _BULLET.match(line):
            share_l += k
        elif len(_STYLE.findall(line)) >= 2:
            share_j += k
        elif closed and m >= 5 and common >= 0.18 * m:
            share_p += k
        elif _is_row(line):
            share_t += k
        elif _KEY_VALUE.match(line):
            share_t += k
        elif _DEFINED.match(line):
            share_l += k
        elif m >= 8 and common < 0.1 * m and len(_SEPARATED.findall(line)) * 5 >= m:
            share_l += k
        elif m <= 4:
            if m == 0 and k > 12:
                share_j += k
            else:
                short += k
        elif common >= 0.18 * m:
            share_p += k
        elif m >= 12 and common < 0.08 * m:
            share_j += k
        else:
            short += k
    # short lines: headings in prose, cells between numbers, else terms of a list
    if short:
        if cells >= 0.15 * len(lines):
            share_t += short
        elif share_p > short * 2:
            share_p += short
        else:
            share_l += short
    s["n_words"], s["n_lines"] = n, len(lines)
    s["mean_word_length"] = sum(map(len, words)) / n if n else 0.0
    s["common_share"] = common_all / n if n else 0.0
    s["odd_word_share"] = sum(len(w) for w in words if _ODD[w]) / max(1, int(count[1]))
    s["separator_rate"] = len(_SEPARATOR.findall(text)) / n if n else 0.0
    s["line_end_share"] = ended / chars
    s["prose_share"], s["list_share"], s["table_share"], s["junk_share"] = share_p / chars, share_l / chars, share_t / chars, share_j / chars
    s["cell_share"] = cells / len(lines)
    if n >= 12:
        distinct = len(set(words))
        if distinct < 0.5 * n:
            runs = len(set(zip(words, words[1:], words[2:], words[3:])))
            s["repeat_share"] = 1 - runs / (n - 3)
    return s


def _is_reference(line: str) -> bool:
    """A quoted title followed by volume, number or pages, or an ISBN or pages alone; linear in the line's length."""
    if _BOOK.search(line):
        return True
    quoted = _QUOTED.search(line) if "”" in line else None
    return bool(quoted and _PLACE.search(line, quoted.end()))


def _is_row(line: str) -> bool:
    """Whether a line is a row of cells: several parts, some of them figures or empty marks, or drawn bars."""
    if "|" not in line and "\t" not in line and ";" not in line and "  " not in line:
        return False
    parts = [p for p in _COLUMNS.split(line) if p]
    if len(parts) < 3:
        return False
    if "|" in line or "\t" in line:
        return len(parts) >= 3 and not (";" in line and "=" in line)
    figures = any(_CELL.match(p) for p in parts)
    return len(parts) <= 12 and (figures or ("  " in line and len(parts) < 8) or (";" in line and "; " not in line and len(parts) < 8))


# name, type it votes for, rule; at most 16 so that patterns fit a bounded table
RULES = [
    ("prose_lines", "prose", lambda s: s["prose_share"] >= 0.5),
    ("common_words", "prose", lambda s: s["common_share"] >= 0.22),
    ("lines_end", "prose", lambda s: s["line_end_share"] >= 0.6 and s["common_share"] >= 0.1),
    ("list_lines", "list", lambda s: s["list_share"] >= 0.5 and s["odd_word_share"] < 0.25),
    ("separated", "list", lambda s: s["separator_rate"] >= 0.2 and s["common_share"] < 0.1 and s["odd_word_share"] < 0.2),
    ("no_ends", "list", lambda s: s["line_end_share"] < 0.3 and s["n_lines"] >= 5 and s["digit_ratio"] < 0.25 and s["table_share"] < 0.3),
    ("table_lines", "table", lambda s: s["table_share"] >= 0.5 and s["odd_word_share"] < 0.25),
    ("cells", "table", lambda s: s["cell_share"] >= 0.2),
    ("figures", "table", lambda s: s["digit_ratio"] >= 0.1 and s["line_end_share"] < 0.5 and s["table_share"] >= 0.3),
    ("junk_lines", "junk", lambda s: s["junk_share"] >= 0.5 or (s["n_words"] < 3 and s["symbol_ratio"] > 0.2)),
    ("symbols", "junk", lambda s: s["symbol_ratio"] >= 0.25 or s["broken_share"] >= 0.03),
    ("odd_words", "junk", lambda s: s["odd_word_share"] >= 0.25),
    ("repeats", "junk", lambda s: s["repeat_share"] >= 0.7),
]


def pattern_of(s: dict[str, float]) -> int:
    return sum(1 << i for i, (_, _, rule) in enumerate(RULES) if rule(s))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trusted = Trusted()
    for batch in batches:
        rows, patterns, residue = [], [], []
        texts = batch.column(1).to_pylist()
        for lo in range(0, len(texts), 64):
            residue += map(bool, trusted.spans(texts[lo : lo + 64]))
        for text in texts:
            s = text_statistics(text)
            rows.append([float(s[k]) for k in STATS])
            patterns.append(pattern_of(s))
        cols = list(zip(*rows)) if rows else [[] for _ in STATS]
        yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, pa.float64()) for c in cols] + [pa.array(patterns, pa.int32()), pa.array(residue, pa.bool_())], ["id", *STATS, "pattern", "residue"])


def statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Statistics, firing pattern and residue flag of every row with a non-blank text; no shuffle.

    Null, empty and blank texts and null ids are left out; repeated rows give
    repeated rows; other columns are ignored; texts are read whole.
    """
    rows = pick(docs, id=id_col, text=text_col).filter(F.col("id").isNotNull() & F.col("text").rlike(r"[^\s\p{Z}]"))
    return spread(rows).mapInArrow(_measure, "id long, " + ", ".join(f"{k} double" for k in STATS) + ", pattern int, residue boolean")


def learn(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60, strength: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over firing patterns: type shares, firing rates (type x rule) and posteriors (pattern x type).

    A weak prior (``strength`` of the documents) says that a rule fires mostly
    on the type it votes for, which names the types.
    """
    fires = (patterns[:, None] >> np.arange(len(RULES))) & 1
    votes = np.array([[t == v for _, v, _ in RULES] for t in TYPES], float)
    rates, shares = 0.02 + 0.68 * votes, np.array([0.7, 0.1, 0.1, 0.1])
    prior_fire, prior_n = (0.02 + 0.68 * votes), strength * counts.sum() / len(TYPES)
    post = np.empty((len(patterns), len(TYPES)))
    for _ in range(rounds):
        log = np.log(shares) + fires @ np.log(rates).T + (1 - fires) @ np.log(1 - rates).T
        log -= log.max(axis=1, keepdims=True)
        post = np.exp(log)
        post /= post.sum(axis=1, keepdims=True)
        w = post * counts[:, None]
        n = w.sum(axis=0)
        rates = np.clip((w.T @ fires + prior_fire * prior_n) / (n + prior_n)[:, None], 1e-3, 1 - 1e-3)
        shares = np.maximum(n / n.sum(), 1e-4)
    return shares, rates, post


def text_types(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Posterior type of every row, and the learnt rates of the rules.

    Types ``(id, kind, p_prose, p_list, p_table, p_junk, residue)``; a tie goes
    to the earlier of prose, list, table, junk.  Rates ``(rule, votes_for,
    prose, list, table, junk)``.  An empty table gives empty types.
    """
    spark = docs.sparkSession
    stats = materialize(statistics(docs, id_col, text_col).select("id", "pattern", "residue"))
    table = stats.groupBy("pattern").count().collect()  # at most 2^len(RULES) rows
    patterns, counts = np.array([r["pattern"] for r in table], np.int64), np.array([r["count"] for r in table], float)
    if not len(table):
        return spark.createDataFrame([], "id long, kind string, p_prose double, p_list double, p_table double, p_junk double, residue boolean"), spark.createDataFrame([], "rule string, votes_for string, prose double, list double, table double, junk double")
    _, rates, post = learn(patterns, counts)
    named = spark.createDataFrame([(int(p), TYPES[int(q.argmax())], *map(float, q.round(6))) for p, q in zip(patterns, post)], "pattern int, kind string, p_prose double, p_list double, p_table double, p_junk double")
    learnt = spark.createDataFrame([(name, vote, *map(float, rates[:, i].round(6))) for i, (name, vote, _) in enumerate(RULES)], "rule string, votes_for string, prose double, list double, table double, junk double")
    return stats.join(F.broadcast(named), "pattern").select("id", "kind", "p_prose", "p_list", "p_table", "p_junk", "residue"), learnt
