"""Sentence boundaries across languages: a pushdown automaton over the marks of a text.

The automaton reads only marks (end marks, quotation marks, brackets, breaks, list
marks).  One stack holds the open quotations and brackets together with whether
they opened the sentence; inside them no mark ends a sentence.  Another holds the
list levels: a number, letter or numeral at a sentence's start pushes a level,
goes on with the one it continues (those inside it are popped) and never ends a
sentence itself; a paragraph without a list mark pops them all.  At depth zero an
end mark ends the sentence unless it belongs to a list mark, the word before it
is in the abbreviation trie, an initial or an ordinal, or what follows cannot
begin a sentence.  Offsets are code points of the text as it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import pick, spread

# Abbreviations that something always follows: titles, references, measures before a number.
ALWAYS = """Mr Mrs Ms Dr Prof St Gen Col Capt Rev Hon Sen Gov Lt Sgt vs viz cf ca e.g i.e approx al
Hr Fr Ing bzw z.B d.h u.a o.ä evtl vgl sog inkl geb
M MM Mme Mlle Me Mgr p.ex env c.-à-d
Sr Sra Srta Dra Ud Uds D Dña aprox p.ej EE.UU
ул просп пл наб им ок т.е проф акад см напр гр тов
κ κα κος Δρ περ π.χ δηλ καθ αρ
डॉ श्री पृ कि.मी प्रो सं
د أ م
ดร รศ ผศ นาย ตร.กม""".split()
# Abbreviations that only a number makes unfinished.
NUMBERED = "no nos vol vols p pp fig figs sect sec ch chap art eq tab ed Nr S Bd Kap Abb Abs n° núm pág págs cap fasc д стр гл рис табл т вып c".split()
# Abbreviations that may also end a sentence; a capital after them begins one.
FINAL = "etc usw Co Ltd Inc Corp Jr Bros a.m p.m т.д т.п г гг в км кв.км кв руб тыс π.Χ μ.Χ κ.λπ κλπ τ.χλμ τ.μ kg km".split()
# What may follow a quotation that opened its sentence, telling who spoke (scripts without capitals).
SPOKE_ZH = re.compile(r"[^。！？\n“「]{0,24}?(?:问|說|说|道|答|喊|叫|写)")
SPOKE_OTHER = re.compile(r"\s*(?:سأل|قال|تساءل|पूछा|ने पूछा|ने कहा)")
ORDINAL_NEXT = re.compile(r"\s*(?:Jahrhundert|Jahrhunderts|Jh|Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Kapitel|Klasse|Stock|Lebensjahr)")
ORDINAL_PREV = re.compile(r"\b(?:am|Am|im|Im|vom|Vom|zum|Zum|bis|seit dem|der|Der|die|Die|das|Das|den|dem|des|beim|ab dem|jeden)\s+$")

OPEN = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "‘": "’", "{": "}"}
CLOSE = {"”", "»", "›", "」", "』", ")", "]", "）", "】", "》", "}"}
ROUND = set("([（【{")
STRONG = set("。！？।॥؟۔｡")
_PARA = re.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85\u2028])(?:[^\S\n\r\x0b\x0c\x85\u2028\u2029]*(?:\r\n|[\n\r\x0b\x0c\x85\u2028]))+|\u2029")
_MARK = re.compile(r"[.!?…。！？।॥؟۔｡;\u037e]+|[“”„«»‹›「」『』()\[\]（）【】《》‘’\"{}]|[^\S\n\r\x0b\x0c\x85\u2028]+(?=[฀-๿])|(?<=[฀-๿\d”\"»)])[^\S\n\r\x0b\x0c\x85\u2028]+")
_BLANK = re.compile(r"\s*")
_WORD = re.compile(r"(?:[^\W\d_][\wऀ-ॣ฀-๿’'²³-]*\.[^\S\n]?)*[^\W_][\wऀ-ॣ’'²³°-]*$|n°$")
_FIRM = re.compile(r"(?:Ltd|Inc|Corp|Co|Jr|Sr|Bros|LLC|GmbH|KG|AG|S\.A)\b")
_NESTING = re.compile(r"[“”„«»‹›「」『』()\[\]（）【】《》‘’\"{}]")
_CLOSING = OPEN | {'"': '"'}
_ITEM = re.compile(r"(\(?\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)]\s")
_LIST = re.compile(r"\s*(?:\(?\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})$")
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12}


class Levels:
    """Stack of the open list levels: kind of mark and the number reached."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int]] = []

    def readings(self, mark: str) -> list[tuple[str, int]]:
        """What a list mark can be: a number, a letter's place, a numeral."""
        word = mark.strip().lstrip("(")
        if word.isdigit():
            return [("digit", int(word))]
        kind = "upper" if word.isupper() else "lower"
        out = [(f"{kind} numeral", _ROMAN[word.lower()])] if word.lower() in _ROMAN else []
        return out + [(kind, ord(word.lower()) - 96)] if len(word) == 1 else out

    def enter(self, mark: str) -> bool:
        """The level a mark continues becomes the innermost; a number, or a first letter or numeral, that continues none opens one.  Whether it did either."""
        found = self.readings(mark)
        for i in range(len(self.open) - 1, -1, -1):
            kind, reached = self.open[i]
            if (kind, reached + 1) in found:
                self.open[i:] = [(kind, reached + 1)]
                return True
        first = next((f for f in found if f[1] == 1 or f[0] == "digit"), None)
        if first:
            kind, value = first  # a kind that is open already starts anew
            at = next((i for i, (k, _) in enumerate(self.open) if k == kind), len(self.open))
            self.open[at:] = [(kind, value)]
        return first is not None


class Trie:
    """Abbreviations stored backwards, walked from the mark to the left."""

    END = ""

    def __init__(self, kinds: dict[str, Iterable[str]]) -> None:
        self.root: dict = {}
        for kind, entries in kinds.items():
            for word in entries:
                node = self.root
                for ch in reversed(word.replace(" ", "")):
                    node = node.setdefault(ch, {})
                node.setdefault(self.END, kind)

    def find(self, text: str, end: int, start: int) -> tuple[str | None, int]:
        """Kind and start of the longest entry that ends at ``end`` and begins a word."""
        node, at, kind, where = self.root, end - 1, None, end
        while at >= start:
            ch = text[at]
            if ch.isspace() and at + 1 < end and text[at - 1 : at] == ".":
                at -= 1  # "z. B." is "z.B."
                continue
            nxt = node.get(ch)
            if nxt is None:
                break
            node = nxt
            before = text[at - 1] if at > start else " "
            if self.END in node and not (before.isalnum() or before == "-"):
                kind, where = node[self.END], at
            at -= 1
        return kind, where


TRIE = Trie({"always": ALWAYS, "number": [*NUMBERED, *(w.capitalize() for w in NUMBERED)], "final": FINAL})


def _pairs(par: str, lo: int, hi: int) -> dict[int, int]:
    """Matching marks of the quotations and brackets of one paragraph; unmatched ones are dropped.

    ``waiting`` counts the open marks each closing mark would match, so a mark
    without a partner costs nothing and any depth takes linear time.
    """
    stack: list[tuple[str, int]] = []
    waiting: dict[str, int] = {}
    match: dict[int, int] = {}
    for m in _NESTING.finditer(par, lo, hi):
        ch, at = m.group(), m.start()
        before = par[at - 1] if at > lo else " "
        after = par[at + 1] if at + 1 < hi else " "
        if ch == "’" and before.isalnum() and after.isalnum():
            continue
        if ch == "‘" and not (before.isspace() or before in "([“«„"):
            continue
        if waiting.get(ch):
            opened = -1
            while opened < 0:  # what is open inside has no partner
                mark, place = stack.pop()
                closing = _CLOSING.get(mark, mark)
                for c in closing:
                    waiting[c] -= 1
                if ch in closing:
                    opened = place
            match[opened] = at
        elif ch == '"' or (ch in OPEN and ch not in CLOSE):
            stack.append((ch, at))
            for c in _CLOSING.get(ch, ch):
                waiting[c] = waiting.get(c, 0) + 1
    return match


def _begins(text: str, at: int, hi: int) -> bool:
    """Whether a sentence can begin at ``at``: anything but a small letter or a joining mark."""
    if at >= hi:
        return True
    ch = text[at]
    if ch.islower():
        return at + 1 < hi and text[at + 1].isupper()  # pH
    return ch not in ",;:·)]}»”’%/&=+" and not (ch in "—–-" and text[at + 1 : at + 2].isspace())


def _ends(text: str, at: int, end: int, start: int, hi: int, levels: Levels) -> bool:
    """Whether the end marks ``text[at:end]`` at depth zero end the sentence begun at ``start``."""
    run = text[at:end]
    nxt = _BLANK.match(text, end, hi).end()
    glued = nxt == end
    if run[-1] in ";\u037e":
        return at > start and "Ͱ" <= text[at - 1].lower() <= "῿" and not glued and _begins(text, nxt, hi)
    if any(c in STRONG for c in run):
        return True
    if nxt >= hi:
        return True
    if set(run) == {"…"} or run.startswith(".."):
        c, cased = text[nxt], text[at - 1 : at].upper() != text[at - 1 : at].lower()
        return not glued and _begins(text, nxt, hi) and (c.isupper() or c.islower() or not c.isalpha() or cased)
    if not _begins(text, nxt, hi):
        return False
    c = text[nxt]
    if run != ".":
        return not glued or c.isupper() or c in OPEN or c == '"' or not c.isascii()
    # a single full stop
    kind, where = TRIE.find(text, at, start)
    if kind == "always":
        return False
    if kind == "number":
        return not c.isdigit()
    word = text[max(start, at - 24) : at]
    last = word[-1:] if word else ""
    if glued:
        solid = last.isdigit() or last in "²³)”»" or (len(word) > 1 and word[-2:].isalpha() and last.islower())
        return solid and (c in OPEN or c == '"' or (c.isupper() and not text[nxt + 1 : nxt + 2] == "."))
    if kind == "final":
        return not c.isdigit() and not _FIRM.match(text, nxt, hi)
    listed = at - start < 12 and bool(_LIST.fullmatch(text[start:at]))
    if listed and levels.enter(text[start:at]) and len(last) and not last.isdigit():
        return False  # a letter or numeral of a list
    if last.isalpha() and last.upper() != last.lower() and (len(word) == 1 or not (word[-2].isalnum())):
        # initials and "z. B.": after one letter a capital goes on; after several (U.K.) it may begin a sentence
        dotted = word[-2:-1] == "." and word[-3:-2].isupper()
        return dotted and not (text[nxt + 1 : nxt + 2] == ".")
    if last.isalpha() and not last.isascii() and (len(word) == 1 or word[-2].isspace()) and not last.islower():
        return False  # one letter of a script without case
    digits = re.search(r"(?<!\d)(?<![.,])\d{1,3}$", word)
    if digits:
        before = text[max(start, at - 40) : at - len(digits.group())]
        if at - start < 12 and (not before.strip() or listed):
            return False  # a list number
        if len(digits.group()) < 3 and (ORDINAL_NEXT.match(text, nxt, hi) or (c.isupper() and ORDINAL_PREV.search(before))):
            return False
    elif listed and len(text[start:at].strip()) == 1:
        return False
    return True


def _after_quote(text: str, opened: int, end: int, start: int, hi: int) -> bool:
    """Whether the quotation or bracket ``text[opened:end]`` ends the sentence begun at ``start``."""
    inner = text[opened + 1 : end - 1].rstrip()
    leads = opened == start
    if not inner or inner[-1] not in ".!?…。！？।॥؟۔｡;\u037e":
        return False
    nxt = _BLANK.match(text, end, hi).end()
    if nxt >= hi:
        return True
    if inner[-1] in ";\u037e" and not ("Ͱ" <= inner[-2:-1].lower() <= "῿"):
        return False
    if text[opened] in ROUND:
        return leads and _begins(text, nxt, hi)
    if not _begins(text, nxt, hi) or text[nxt] in ".!?。！？।؟…":
        return False
    c = text[nxt]
    if c.isalpha() and not (c.isupper() or c.islower()):
        if "぀" <= c <= "ヿ":
            return not text.startswith(("と", "って", "という"), nxt)
        if leads and "一" <= c <= "鿿" and SPOKE_ZH.match(text, nxt, hi):
            return False
        if leads and SPOKE_OTHER.match(text, nxt, hi):
            return False
        return not ("฀" <= c <= "๿")
    return True


def _thai(text: str, start: int, at: int) -> bool:
    """Whether the last letter before ``at`` is Thai."""
    while at > start:
        at -= 1
        if text[at].isalpha() or "\u0e00" <= text[at] <= "\u0e7f":
            return "\u0e00" <= text[at] <= "\u0e7f"
    return False


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Spans ``[start, end)`` of the sentences of one text, blanks at either end left out."""
    return [(a, b) for a, b, _ in leveled_spans(text)]


def leveled_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the sentences of one text, with the list level each stands on (0: no list)."""
    spans: list[tuple[int, int, int]] = []
    levels = Levels()
    lo, breaks = 0, [(m.start(), m.end()) for m in _PARA.finditer(text)]
    for stop, resume in [*breaks, (len(text), len(text))]:
        start = _BLANK.match(text, lo, stop).end()
        if start < stop:
            item = _ITEM.match(text, start, stop)
            if item is None:
                levels.open.clear()
            elif text[item.end() - 2] == ")":
                levels.enter(item[1])
            match = _pairs(text, start, stop)
            at = start
            while at < stop:
                m = _MARK.search(text, at, stop)
                if m is None:
                    break
                p, at = m.start(), m.end()
                if p in match:  # push: everything up to the matching mark is inside
                    at = match[p] + 1
                    done = _after_quote(text, p, at, start, stop)
                elif text[p].isspace():
                    done = _thai(text, start, p) or (text[at : at + 1] > "\u0e00" and text[at : at + 1] < "\u0e80")
                elif text[p] in ".!?…。！？।॥؟۔｡;\u037e":
                    done = _ends(text, p, at, start, stop, levels)
                else:
                    continue
                if done:
                    nxt = _BLANK.match(text, at, stop).end()
                    end = p if text[p].isspace() else at
                    if end > start:
                        spans.append((start, end, len(levels.open)))
                    start = at = nxt
            if start < stop:
                end = stop
                while text[end - 1].isspace():
                    end -= 1
                spans.append((start, end, len(levels.open)))
        lo = resume
    return spans


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        who, no, a, b, n, s = [], [], [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            for k, (x, y, z) in enumerate(leveled_spans(text)):
                who.append(i), no.append(k), a.append(x), b.append(y), n.append(z), s.append(text[x:y])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int32())), pa.array(no, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32()), pa.array(s, pa.string())], ["id", "sentence_no", "start_at", "end_at", "list_level", "sentence"])


def sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sentences ``(id, sentence_no, start_at, end_at, list_level, sentence)`` of every text.

    One pass, no shuffle; a text is read whole whatever its length.  Null,
    empty and blank texts give no rows, repeated rows give repeated sentences,
    rows with a null id are left out, other columns are ignored.
    """
    rows = pick(docs, id=id_col, text=text_col).filter("id is not null and text is not null and text <> ''")
    return spread(rows).mapInArrow(_run, "id long, sentence_no int, start_at long, end_at long, list_level int, sentence string")
