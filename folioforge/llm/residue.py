"""Template residue, filler and error pages in place of content.

Every sentence and line of a document is a *unit*.  Units that match one of a
few families of strict patterns (unfilled fields, filler, status lines, script
and cookie demands, messages of programs) are trusted residue, in texts of any
length.  All units get a 64-bit SimHash over their masked words (numbers and names
become classes, brackets and braces stay part of the word) and word pairs.
SimHash tables partitioned by pairs of 13-bit blocks find every unit within
Hamming distance 3 of a labelled one.  That meets few pairs at word likeness 0.8,
so a prefix index finds the others: units of that likeness share one of their
rarest words, without exception.  Word likeness is verified, and the label moves
on through the connected component until no unit is added.  Units of fewer than
four telling words are compared by all their words, names as they stand, which
at that likeness comes to being the same line.  A label given for a field
or blank value moves only to units that hold a mark themselves: the same sentence
filled in is content.  Components without a trusted unit are never touched, so
their pairs need not be formed.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import _powers, _tables, mix64
from ..operators.tables import materialize, pick, release, rows_at_most, spread

BLOCKS = 5
BLOCK_BITS = 13
RADIUS = 3
BROADCAST_ROWS = 20_000
SHORT = 4  # telling words below which the names and numbers of a unit count as words too
SAMPLED_UNITS = 50_000  # for the order of words only
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_NUMBER, _NAME = np.uint64(0x1234567), np.uint64(0x7654321)

_QUOTES = {"“": "”", "«": "»", "„": "“", '"': '"'}
_OPENING = re.compile("[“«„\"]")
_FIELD = re.compile(
    r"\{\{\{?\s*[a-z][\w -]*\|?\s*\}?\}\}|<%=?\s*\w+\s*%>|\$\{[a-z]\w*\}|%\([a-z]\w*\)s|@@\w+@@|(?<!\w)__[A-Z]+\d?__(?!\w)|#[A-Z]{3,}\d?#"
    r"|<(?!(?:b|i|u|p|br|hr|em|li|ol|ul|tt|td|tr|th|div|ref|sub|sup|span|code|math|table|small|strong|center|gallery|nowiki|pre)>)[a-z]{3,}\d?>|&lt;[a-z]{3,}\d?&gt;"
    r"|\[[A-Z]{3,}\d?\]|\[(?:insert|enter|your|add|name of)\b[^\]\n]{1,40}\]|\((?:[a-z]+\d? )+goes here\)|\{\d\}|(?<![\w$%{\\])\{[a-z][a-z_]{1,24}\}(?!\})",
    re.I,
)
_UPPER_FIELD = re.compile(r"\[[A-Z]{3,}\d?\]|#[A-Z]{3,}\d?#|__[A-Z]+\d?__")
_ABOUT = re.compile(r"\b(?:such as|as in|the form|is written|are written|stands? for|the phrase|the words?|a habit|asked (?:readers|users|visitors|people)|is called|means|in a draft|the message|answers with)\b", re.I)
# Reason phrases of HTTP status codes from 400 on.
_REASONS = "bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|request time-?out|conflict|gone|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out"
_BLANK_VALUE = r"(?:TBD|TBA|\?{3,}|_{3,}|X{2,}|\.{4,}|dd/mm/yyyy|00/00/0000|\[ ?\]|\(to be filled in\)|N\.N\.)"
_UNFILLED = re.compile(rf"(?:^|[;,|] )\s*(?:[A-Z][\w -]{{2,24}}:\s*|[a-z][\w ]{{2,24}} ){_BLANK_VALUE}(?=\s*(?:[;,|]|\.?\s*$))")
_NOTICE = re.compile(
    r"java ?script.{0,60}\b(?:disabled|required|needed|off)\b|\b(?:enable|turn on|activate|allow|need|requires?|permit)\b.{0,40}\b(?:java ?script|scripting|scripts)\b|(?:aktivieren|activer|activar|attivare).{0,20}java ?script"
    r"|\bnoscript\b|without JS\b|\bneeds? scripts\b|scripting is (?:permitted|disabled|required)|browser does not support"
    r"|^\W*(?:error|erreur|fehler|errore)\s*\d{3}\b|\b(?:script|expression|template|parse|lua) error\b\s*(?::|in\b)|template loop detected|expansion stopped after|database (?:query )?error has|lock wait exceeded"
    r"|gateway timed out|\b50\d service unavailable|^\W*\d{3} (?:service unavailable|not found|forbidden|bad gateway)|^\W*access denied\W*$|permission to (?:read|view|access|see) this page|session has expired|this revision .{0,20}does not exist"
    rf"|^\W*(?:(?:http(?:/\d(?:\.\d)?)?|error|status(?: code)?)\W*){{0,3}}[45]\d\d\W+(?:{_REASONS})\b|^\W*(?:internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|too many requests)\W*$"
    r"|\b(?:unexpected|unknown|internal) error (?:has )?occurred\b|^\W*(?:sorry|oops)\b.{0,40}\bwent wrong\b|(?:failed|unable) to (?:load|fetch|retrieve) (?:the )?(?:resource|page|content|data|image|script)\b|\bconnection (?:timed out|reset by peer)|\buncaught (?:exception|\w*error)\b"
    r"|\bundefined (?:index|variable|offset|function|method)\b|^\W*(?:this )?(?:page|site|website) (?:is )?(?:currently |still )?under construction\W*$|^\W*(?:loading|please wait)\W*$|\b(?:enable|allow|accept) cookies\b|\bcookies (?:are|must be) (?:disabled|enabled)\b"
    r"|page you (?:asked for|requested|are looking for)|^\W*(?:seite|page) (?:nicht gefunden|not found)\W*$|\bfehlercode\b|^\W*fatal (?:exception|error)\b|^\W*traceback\b|having technical (?:problems|difficulties)|cannot reach the (?:data(?:base)? )?server|server did not answer in time|upstream host closed",
    re.I,
)
_FILLER = re.compile(
    r"\bplaceholder (?:copy|text)\b.*(?:follow|replace)|real text will follow|\bdummy text\b|^\W*sample text for\b|(?:text|heading|caption|title|content|description)(?: \d+)? goes here\W*$|^\W*your [a-z]+ here\W*$|^description of .{1,60} to be added\W*$|^\W*TODO\b"
    r"|^\W*(?:(?:insert|type|paste) (?:[\w-]+ ){0,4}|(?:add|enter|write|put) your (?:[\w-]+ ){0,3})here\W*$|^\W*(?:sample|placeholder|dummy|filler) (?:text|copy|content|paragraph|title|heading)\W*$|^\W*FIXME\b"
    r"|^\W*click to edit\b|^\W*replace this (?:paragraph|text|section)\b|\b(?:image|text|content) coming soon\b",
    re.I,
)
# The words of the common pseudo-Latin filler.
LATIN = set("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna magnis aliqua urna donec velit fusce porta cursus nulla morbi lectus sapien quis nonum nonummy vestib vestibulum ornare enim ad minim veniam nostrud".split())
REPEATED = set("blah bla test foo bar baz word xxx asdf text qwerty abc yada".split())
# A part of every way a unit can match _FIELD, _UNFILLED, _NOTICE or _FILLER, in lower case and without blanks (a quotation
# left out may put one anywhere). The last three are letters that match i and s where case is ignored.
_TRIGGERS = (
    "{ < &lt; ${ %( @@ __ # [ goes tbd tba ??? ___ xx .... dd/mm 00/00 filled n.n. "
    "script js browser error erreur fehler loop expansion exceeded timed unavailable found forbidden gateway denied permission expired revision page gefunden fatal traceback technical reach answer upstream "
    "placeholder follow dummy sample your added todo click replace coming insert type paste filler fixme "
    "requests occurred wrong resource content data image connection uncaught undefined construction loading wait cookies \u0130 \u0131 \u017f"
).split() + [str(n) for n in range(400, 600)]
#: Words of LATIN and REPEATED, standing alone, that a unit of filler has at least.
FILLER_WORDS = 3


def without_quotations(unit: str) -> str:
    """The unit with a blank for every quotation, however long; an opening mark without its partner stays.  Linear in the length."""
    out, at, lone = [], 0, set()
    for m in _OPENING.finditer(unit):
        if m.start() < at or m.group() in lone:
            continue
        end = unit.find(_QUOTES[m.group()], m.end())
        if end < 0:
            lone.add(m.group())
        else:
            out.append(unit[at : m.start()])
            at = end + 1
    return " ".join([*out, unit[at:]])


def is_residue(unit: str) -> bool:
    """Whether one unit, on its own, is trusted residue: a strict pattern outside quotation marks and not spoken about."""
    return residue_kind(unit) is not None


def residue_kind(unit: str) -> str | None:
    """``message``, ``filler`` or ``mark`` (a field or blank value alone) for trusted residue."""
    words = re.findall(r"[^\W\d_]+", unit.lower())
    if len(words) >= 4 and sum(w in LATIN for w in words) >= 0.7 * len(words):
        return "filler"
    tokens = unit.lower().rstrip(".!? ").split()
    if tokens and any(c.isdigit() for c in tokens[-1]):
        tokens.pop()  # a code after the filler
    if len(tokens) >= 4 and len(set(tokens)) <= 2 and set(tokens) <= REPEATED:
        return "filler"
    plain = without_quotations(unit)
    told = "message" if _NOTICE.search(plain) else "filler" if _FILLER.search(plain) else None
    if told and not _ABOUT.search(plain):
        return told
    fields = [m.group() for m in _FIELD.finditer(plain) if not m.group().startswith(("[", "#", "__")) or _UPPER_FIELD.match(m.group()) or m.group().lower().startswith(("[your", "[insert", "[enter", "[add", "[name"))]
    if fields and (len(fields) > 1 or not _ABOUT.search(plain)):
        return "mark"
    return "mark" if _UNFILLED.search(plain) else None


def _automaton() -> ahocorasick.Automaton:
    """Triggers with value 0, words of filler with their length."""
    a = ahocorasick.Automaton()
    for w in LATIN | REPEATED:
        a.add_word(w, len(w))
    for t in _TRIGGERS:
        a.add_word(t, 0)
    a.make_automaton()
    return a


def _letters() -> np.ndarray:
    """Whether a character below 0x250 is a letter, as in the words of ``residue_kind``."""
    return np.array([re.match(r"[^\W\d_]", chr(c)) is not None for c in range(0x250)])


def suspects(joined: str, start: np.ndarray, triggers: ahocorasick.Automaton, letter: np.ndarray) -> np.ndarray:
    """Units that may be residue: those with a trigger, or with a few words of filler; no unit that ``residue_kind`` takes is left out."""
    low = joined.lower()
    if len(low) != len(joined):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in joined)
    hits = np.array(list(triggers.iter(low)), np.int64).reshape(-1, 2)
    unit = np.maximum(np.searchsorted(start, hits[:, 0], side="right") - 1, 0)
    word = hits[:, 1] > 0
    cp = np.frombuffer(f" {low} ".encode("utf-32-le", "surrogatepass"), np.uint32)  # one place further on
    edge = np.append(letter, False)[np.minimum(cp, letter.size)]
    whole = word & ~edge[hits[:, 0] + 2] & ~edge[hits[:, 0] + 1 - hits[:, 1]]
    filler = np.bincount(unit[whole], minlength=start.size) >= FILLER_WORDS
    return np.union1d(unit[~word], np.flatnonzero(filler))


def _unit_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low, word = _tables()
    word = word.copy()
    for c in "{}[]<>%@$#_()":
        word[ord(c)] = True
    kind = np.zeros(0x110000, np.int8)  # 1 digit, 2 capital, 3 mark of a field
    for cp in range(0x3000):
        c = chr(cp)
        kind[cp] = 1 if c.isdigit() else 2 if c.isupper() else 3 if c in "{}[]<>%@$#_" else 0
    return low, word, kind, _breaks()


def unit_stops(cp: np.ndarray, brk: np.ndarray, separators: str = "") -> np.ndarray:
    """Whether a unit begins at a character: at line breaks, at blanks after end marks and at ``separators``."""
    stop = np.zeros(cp.size, bool)
    stop[1:] = np.isin(cp[:-1], (46, 33, 63)) & ((cp[1:] == 32) | (cp[1:] == 160))
    stop |= brk[cp]
    for c in separators:
        stop |= cp == ord(c)
    return stop


KINDS = [None, "message", "mark", "filler"]


class Trusted:
    """Trusted residue in batches of texts."""

    def __init__(self) -> None:
        self.triggers, self.letter, self.brk = _automaton(), _letters(), _breaks()

    def kinds(self, joined: str, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the units of joined texts begin, and the place of each one's kind in :data:`KINDS`."""
        first = np.concatenate(([0], np.flatnonzero(unit_stops(cp, self.brk)), [cp.size]))
        kind = np.zeros(first.size - 1, np.int8)
        for u in suspects(joined, first[:-1], self.triggers, self.letter).tolist():
            found = residue_kind(joined[first[u] : first[u + 1]].strip())
            kind[u] = KINDS.index(found)
        return first, kind

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Residue units of each text: places in it, and their kind."""
        joined = "\n".join(texts) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        first, kind = self.kinds(joined, cp)
        base = np.cumsum([0] + [len(t) + 1 for t in texts])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for u in np.flatnonzero(kind).tolist():
            # a text's first unit begins at the break before it
            o = int(np.searchsorted(base, first[u + 1] - 1, side="right")) - 1
            out[o].append((max(0, int(first[u] - base[o])), int(first[u + 1] - base[o]), int(kind[u])))
        return out

    def without(self, texts: list[str]) -> list[str]:
        """The texts without their residue units; empty where messages are a third of a text, as what else stands there belongs to them."""
        return [_cut_out(t, s) if s else t for t, s in zip(texts, self.spans(texts))]


def _cut_out(text: str, spans: list[tuple[int, int, int]]) -> str:
    if 3 * sum(b - a for a, b, kind in spans if KINDS[kind] == "message") >= len(text):
        return ""
    out, at = [], 0
    for a, b, _ in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def _breaks() -> np.ndarray:
    brk = np.zeros(0x110000, bool)
    brk[[10, 11, 12, 13, 0x85, 0x2028, 0x2029]] = True
    return brk


def unit_features(texts: list[str], tables, separators: str = "", hashes: bool = True, quoted: bool = False) -> dict[str, np.ndarray]:
    """Units of a batch of texts: spans in the joined code points, masked words and, with ``hashes``, keys and SimHashes.

    Units end at line breaks, at end marks before a blank and at ``separators``.
    With ``quoted`` a capital after a quotation mark does not make a name.
    """
    low, is_word, kind, brk = tables
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    mask = is_word[cp]
    stop = unit_stops(cp, brk, separators)
    edge = np.diff(mask.view(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - begin
    where = np.flatnonzero(mask)
    first = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    place = (where - np.repeat(begin, size)) & 255
    chars = cp[where]
    h = mix64(np.add.reduceat((low[chars].astype(np.uint64) + np.uint64(1)) * _powers()[place], first) + size.astype(np.uint64) * _M1)
    digit = (np.add.reduceat((kind[chars] == 1).astype(np.int32), first) > 0) & (np.add.reduceat((kind[chars] == 3).astype(np.int32), first) == 0)
    capital = kind[cp[begin]] == 2
    unit = np.cumsum(stop)[begin]
    fresh = np.concatenate(([True], unit[1:] != unit[:-1]))
    if quoted:
        before = cp[np.maximum(begin - 1, 0)]
        capital &= (before != 0x201C) & (before != 0x22) & (before != 0x2018)
    h[digit] = _NUMBER
    plain = h.copy() if hashes else h
    h[capital & ~fresh & ~digit] = _NAME
    starts = np.flatnonzero(fresh)
    n = np.diff(np.concatenate((starts, [h.size])))
    inner = np.arange(h.size, dtype=np.int64) - np.repeat(starts, n)
    ustart = begin[starts]
    uend = np.concatenate((ustart[1:], [cp.size]))
    owner_at = np.cumsum([0] + [len(t) + 1 for t in texts])
    out = {"start": ustart, "end": uend, "n": n, "words": h, "first": starts, "owner": np.searchsorted(owner_at, ustart, side="right") - 1, "chars": chars, "char_first": first[starts], "joined": joined, "cp": cp, "unit": unit[starts]}
    if not hashes:
        return out
    # where few words tell anything, names do
    classes = (h == _NUMBER) | (h == _NAME)
    count = np.add.reduceat(classes.astype(np.int64), starts)
    short = n - count < SHORT
    whole = np.where(np.repeat(short, n), plain, h)
    key = mix64(np.add.reduceat(mix64(whole + inner.astype(np.uint64) * _M2), starts))
    pair = np.where(inner > 0, mix64(h * _M1 + np.roll(h, 1)), h)
    telling = ((h != _NUMBER) & (h != _NAME)).astype(np.int16)  # classes count in pairs only
    sim = np.empty(starts.size, np.uint64)
    shifts = np.arange(64, dtype=np.uint64)
    weight = np.uint64(1) << shifts
    lo = 0
    while lo < starts.size:  # a few thousand words at a time
        hi = int(np.searchsorted(starts, starts[lo] + 4096, side="left"))
        hi = max(hi, lo + 1)
        a, b = starts[lo], starts[hi] if hi < starts.size else h.size
        votes = (2 * ((h[a:b, None] >> shifts) & np.uint64(1)).astype(np.int16) - 1) * telling[a:b, None]
        votes += 2 * ((pair[a:b, None] >> shifts) & np.uint64(1)).astype(np.int16) - 1
        sim[lo:hi] = ((np.add.reduceat(votes, starts[lo:hi] - a, axis=0) > 0) * weight).sum(axis=1, dtype=np.uint64)
        lo = hi
    return out | {"key": key, "sim": sim, "whole": whole, "classes": classes, "short": short, "vague": 2 * count > n}


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables, trusted = _unit_tables(), Trusted()
    seen: set[int] = set()
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (chars < 200_000 or hi == lo):
                chars += len(texts[hi])
                hi += 1
            part = texts[lo:hi]
            if not any(re.search(r"\w", t) for t in part):
                lo = hi
                continue
            f = unit_features(part, tables)
            kind = trusted.kinds(f["joined"], f["cp"])[1][f["unit"]]
            residue = kind > 0
            marked = np.add.reduceat(tables[2][f["chars"]] == 3, f["char_first"]) > 0
            marked[residue] = kind[residue] == KINDS.index("mark")
            keys = f["key"].view(np.int64)
            fresh = np.zeros(keys.size, bool)
            for i, (k, r) in enumerate(zip(keys.tolist(), residue.tolist())):
                tag = k * 2 + r
                if tag not in seen:
                    seen.add(tag)
                    fresh[i] = True
            words = (f["whole"] >> np.uint64(32)).astype(np.uint32)
            telling = ~f["classes"]
            payload = [(words[a : a + n] if s else words[a : a + n][telling[a : a + n]]).tobytes() if g else None for a, n, g, s in zip(f["first"].tolist(), f["n"].tolist(), fresh.tolist(), f["short"].tolist())]
            # SimHashes of units mostly of numbers and names are much alike: those units go by the prefix index alone
            vague = f["vague"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[lo:hi][f["owner"]], pa.int64()), pa.array(keys), pa.array(f["sim"].view(np.int64), mask=~fresh | vague), pa.array(payload, pa.binary()), pa.array(residue), pa.array(marked)],
                ["id", "key", "sim", "words", "residue", "marked"],
            )
            lo = hi


def document_units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, key, sim, words, residue, marked)`` of every unit; ``words`` and, unless most words are numbers or names, ``sim`` come with the first unit of a key in each task.

    ``marked``: of residue, that a field or blank value alone makes it so; of other units, that they hold a mark of a field.
    """
    rows = pick(docs, id=id_col, text=text_col).filter("id is not null and text is not null and text <> ''")
    return spread(rows).mapInArrow(_units, "id long, key long, sim long, words binary, residue boolean, marked boolean")


def _tables_of(rows: DataFrame) -> DataFrame:
    """One row for each of the ten tables: the pair of blocks a near unit must agree on (distance 3 leaves two of five blocks whole)."""
    block = [F.shiftrightunsigned("sim", i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for i in range(BLOCKS)]
    keys = [F.lit(t * (1 << 26)).cast("long") + block[i] * (1 << BLOCK_BITS) + block[j] for t, (i, j) in enumerate(itertools.combinations(range(BLOCKS), 2))]
    return rows.select("*", F.explode(F.array(*keys)).alias("slot"))


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                ua, ca = np.unique(a, return_counts=True)
                ub, cb = np.unique(b, return_counts=True)
                _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
                common = int(np.minimum(ca[i], cb[j]).sum())
                keep.append(common + 1e-9 >= threshold * (a.size + b.size - common))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["key", "field"])

    return run


def rarest_words(words: list[bytes], common: np.ndarray, rank: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes of units in one order of words: ``(unit, token)``, of n words the rarest ``n - ceil(threshold n) + 1``.

    Units whose likeness is at least ``threshold`` share a token of their
    prefixes, whatever the order is.  ``common`` (sorted) and ``rank`` put
    frequent words last, so that few other units share one.  A word that occurs
    again is another word.
    """
    flat = np.frombuffer(b"".join(words), np.uint32)
    n = np.array([len(w) // 4 for w in words], np.int64)
    owner = np.repeat(np.arange(n.size), n)
    flat = flat[np.lexsort((flat, owner))]
    at = np.arange(flat.size)
    fresh = np.ones(flat.size, bool)
    fresh[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
    token = flat.astype(np.uint64) | (nth.astype(np.uint64) << np.uint64(32))
    place = np.searchsorted(common, flat)
    known = np.append(common, np.uint32(0))[place] == flat
    known &= place < common.size
    order = np.lexsort((token, np.where(known, np.append(rank, 0)[place], 0), owner))
    size = np.minimum(n, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)
    first = np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64)
    kept = order[at - np.repeat(first, n) < np.repeat(size, n)]
    return owner[kept], mix64(token[kept]).view(np.int64)


def _word_order(known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words of a bounded sample of units that occur in it more than once, with their counts."""
    step = max(1, known.count() // SAMPLED_UNITS)
    sample = known.filter(F.pmod("key", F.lit(step)) == 0).select("words").limit(2 * SAMPLED_UNITS).collect()
    words, counts = np.unique(np.frombuffer(b"".join(r["words"] for r in sample), np.uint32), return_counts=True)
    return words[counts > 1], counts[counts > 1]


def _prefixes(order: tuple[np.ndarray, np.ndarray], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1).to_pylist()
            if not words:
                continue
            owner, token = rarest_words(words, *order, threshold)
            offsets = np.searchsorted(owner, np.arange(len(words) + 1)).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(token))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) // 4 for w in words], pa.int32()), batch.column(2), tokens], ["key", "n", "marked", "tokens"])

    return run


def residue_documents(docs: DataFrame, id_col: str, text_col: str, similarity: float = 0.8) -> DataFrame:
    """One row ``(id, n_units, n_trusted)`` for every document with residue.

    ``n_units`` counts its residue units, ``n_trusted`` those matched by a
    pattern themselves.  Null and empty texts and null ids take no part, an id
    counts once however many rows carry it, an empty table gives none, other
    columns are ignored.  Long texts are read whole.  Labels move until none is
    added.
    """
    units = materialize(document_units(docs, id_col, text_col))
    known = units.filter("words is not null").groupBy("key").agg(F.first("sim").alias("sim"), F.first("words").alias("words"), F.max("residue").alias("residue"), F.coalesce(F.min(F.when(F.col("residue"), F.col("marked"))), F.max("marked")).alias("marked"))
    known = materialize(known)
    labelled = materialize(known.filter("residue").select("key", "sim", "words", F.col("marked").alias("field")))
    frontier = labelled
    prefixes = _prefixes(_word_order(known), similarity)
    schema = "key long, n int, marked boolean, tokens array<long>"
    pool = known.filter("not residue").select("key", "sim", "words", "marked")
    rare = materialize(pool.select("key", "words", "marked").mapInArrow(prefixes, schema))
    while True:
        small = rows_at_most(frontier, BROADCAST_ROWS)
        probe = _tables_of(frontier.filter("sim is not null").select(F.col("key").alias("source"), F.col("sim").alias("s2"), "sim", "field")).drop("sim")
        met = _tables_of(pool.filter("sim is not null").select("key", "sim", "marked")).join(F.broadcast(probe) if small else probe, "slot").filter(F.bit_count(F.col("sim").bitwiseXOR(F.col("s2"))) <= RADIUS)
        probe = frontier.select("key", "words", F.col("field").alias("marked")).mapInArrow(prefixes, schema).select(F.col("key").alias("source"), F.col("n").alias("m"), F.col("marked").alias("field"), F.explode("tokens").alias("token"))
        probe = materialize(probe)
        shared = rare.select("key", "n", "marked", F.explode("tokens").alias("token")).join(F.broadcast(probe) if rows_at_most(probe, 8 * BROADCAST_ROWS) else probe, "token").filter(F.least("n", "m") + 1e-9 >= similarity * F.greatest("n", "m"))
        near = met.select("key", "source", "marked", "field").union(shared.select("key", "source", "marked", "field"))
        near = materialize(near.filter("marked or not field").select("key", "source", "field").distinct())
        few = rows_at_most(near, BROADCAST_ROWS)
        pairs = pool.select("key", "words").join(F.broadcast(near) if few else near, "key").join(frontier.select(F.col("key").alias("source"), "field", F.col("words").alias("w2")), ["source", "field"])
        moved = pairs.select("key", "field", "words", "w2").mapInArrow(_similar(similarity), "key long, field boolean").groupBy("key").agg(F.min("field").alias("field"))
        had = labelled.groupBy("key").agg(F.min("field").alias("had"))
        new = moved.join(had, "key", "left").filter("had is null or had and not field").select("key", "field")
        last, frontier = frontier, materialize(new.join(known, "key").select("key", "sim", "words", "field"))
        done = frontier.isEmpty()
        if not done:
            former, labelled = labelled, materialize(labelled.union(frontier))
            release(former)
        for used in (probe, near, last if last is not labelled else probe):
            release(used)
        if done:
            break
    keys = materialize(labelled.groupBy("key").agg(F.min("field").alias("field")))
    near = units.filter("not residue").join(F.broadcast(keys) if rows_at_most(keys, BROADCAST_ROWS) else keys, "key").filter("marked or not field").select("id", "residue")
    hit = units.filter("residue").select("id", "residue").union(near)
    return hit.groupBy("id").agg(F.count("*").alias("n_units"), F.count_if("residue").alias("n_trusted"))
