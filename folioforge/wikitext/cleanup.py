"""Expanded wikitext to plain text: strip markup, drop debris, clean up.

Every pass is a pure function of text.  Template output is still wrapped in
``\\x01`` ... ``\\x02``; passes that treat it more severely than the article's
own words look at these marks, and the last pass removes them.
"""

from __future__ import annotations

import html
import re

from . import values

A, Z = "\x01", "\x02"
_MARKS = re.compile("[\x01\x02]")

# Fixed values.
EXTENSIONS = "timeline mapframe maplink gallery imagemap graph score templatedata categorytree".split()
DROPPED = "gallery imagemap nowiki source syntaxhighlight math score timeline noinclude templatestyles mapframe maplink graph templatedata categorytree".split()
PRE_DROPPED = "timeline gallery imagemap math score source syntaxhighlight mapframe maplink graph templatedata categorytree".split()
BLOCKS = "div p table caption tr td th li ul ol dl dd dt blockquote center section figure figcaption pre hr h1 h2 h3 h4 h5 h6".split()
FILES = "file image fichier imagen datei archivo media".split()
SISTERS = "commons wikisource wiktionary wikibooks wikiversity wikispecies".split()
LEAKED = "nowrap noprint plainlist hlist plainlinks vcard navbox sidebar infobox collapsible autocollapse collapsed mw-collapsible vevent geoshape".split()
STYLE_PROPERTIES = "background text-align font-size vertical-align border padding margin color: width: height: display: float: position:".split()
TABLE_ATTRIBUTES = ["bgcolor", "cellspacing", "cellpadding", "rowspan=", "colspan=", 'align="', "valign=", 'scope="', "nowrap", 'width="', 'height="', 'border="']
CSS = "background-color: background: text-align: vertical-align: border-collapse font-size: font-weight: font-style: line-height: padding: padding- margin: margin- border: border- color: display: float: overflow: white-space: text-decoration: text-indent: max-width: min-width: position: z-index: opacity: cursor: visibility:".split()
MESSAGES = ["unrecognized country", "Page using Template:", "unknown parameter"]


def drop_extensions(text: str, names: list[str] = EXTENSIONS) -> str:
    """Extension tags with their bodies; map tags also when self-closing."""
    tags = "|".join(names)
    text = re.sub(rf"(?is)<(?:mapframe|maplink)\b[^>]*/>", "", text)
    return re.sub(rf"(?is)<({tags})\b[^>]*(?<!/)>.*?</\1\s*>", "", text)


def template_body(text: str) -> str:
    """What a template's page contributes: the onlyinclude parts, or all but noinclude parts."""
    only = re.findall(r"(?s)<onlyinclude>(.*?)</onlyinclude>", text)
    if only:
        text = "".join(only)
    else:
        text = re.sub(r"(?s)<noinclude>.*?</noinclude>|<noinclude\s*/>|<noinclude>.*\Z", "", text)
        text = re.sub(r"</?includeonly\s*/?>", "", text)
    return drop_extensions(re.sub(r"(?s)<!--.*?-->", "", text))


# marks of template output -------------------------------------------------


def _wordish(c: str) -> bool:
    if c < "\x80":
        return c.isalnum()
    return not ("\x80" <= c <= "\xbf" or "\u2000" <= c <= "\u2fff")


def outer_marks(text: str) -> str:
    """Keep the outermost marks; a template boundary between two word characters gets a blank."""
    out: list[str] = []
    depth, edge, last = 0, False, ""
    for piece in re.split("([\x01\x02])", text):
        if piece == A:
            depth += 1
            edge = True
            if depth == 1:
                out.append(A)
        elif piece == Z:
            edge = True
            if depth:
                depth -= 1
                if not depth:
                    out.append(Z)
        elif piece:
            if edge and last and _wordish(last) and _wordish(piece[0]):
                out.append(" ")
            edge, last = False, piece[-1]
            out.append(piece)
    return "".join(out)


# strip --------------------------------------------------------------------


def _leftover(m: re.Match) -> str:
    parts = m[1].split("|")
    if parts[0].lstrip().startswith("#"):
        return ""
    kept = []
    for p in parts[1:]:
        name, eq, value = p.partition("=")
        v = (value if eq and len(name.encode()) < 40 else p).strip(" \t\r\n")
        if v and values.keep_leftover(v):
            kept.append(v)
    return "\n".join(kept)


def _fixpoint(pattern: str, replace, text: str, most: int = 10, flags: int = 0) -> str:
    rx = re.compile(pattern, flags)
    for _ in range(most):
        new = rx.sub(replace, text)
        if new == text:
            break
        text = new
    return text


def strip_markup(text: str, namespaces: list[str] = (), compat: bool = False) -> str:
    """Leftover parameters and calls, links, stray brackets and braces.

    ``namespaces`` names the wiki's own file and category namespaces; with
    ``compat`` every link target that begins with "cat" goes too.
    """
    text = _fixpoint(r"\{\{\{[^{}|]*\|([^{}]*)\}\}\}", r"\1", text)
    text = re.sub(r"\{\{\{[^{}|]*\}\}\}", "", text)
    text = _fixpoint(r"\{\{(?!\|)([^{}]*)\}\}", _leftover, text, flags=re.S)
    text = re.sub(r"(?<!\|)\}(?!\})|\}\}+", lambda m: m[0] if m.start() and text[m.start() - 1] == "|" else "", text)
    names = "|".join(re.escape(n.lower()) for n in [*FILES, "category", *namespaces])
    gone = re.compile(rf"(?i)\s*:?(?:(?:{names})\s*:" + ("|cat" if compat else "") + ")")

    def link(m: re.Match) -> str:
        inner = m[1]
        if gone.match(_MARKS.sub("", inner)) or re.match(r"[a-z]{2,3}:", inner):
            return ""
        return inner.rsplit("|", 1)[-1]

    text = _fixpoint("\\[[\x01\x02]?\\[((?:(?!\\[\\[|\\]\\]).)*?)\\]\\]", link, text, flags=re.S)
    return re.sub(r"\[[^\[\]\n]*\bmodifier\]|\[\[|\]\]", "", text)


# debris -------------------------------------------------------------------

_BARE = re.compile(r"[a-z-]{2,}=")


def _digit_heavy(s: str) -> bool:
    chars = [c for c in s if not c.isspace()]
    return bool(chars) and len(values._DIGIT.findall(s)) * 2 >= len(chars)


def _debris(segment: str, n: int, own_line: bool) -> bool:
    d = re.sub(r"^[-*] +", "", segment) if n > 2 else segment
    m = values.size(d)
    return bool(
        (2 < m < 80 and d.endswith("="))
        or (3 <= m < 60 and d[0] == '"' == d[-1])
        or (3 < m < 80 and re.match(r"[a-z-]{2,}=.", d))
        or "bgcolor" in d or "colspan" in d or "rowspan" in d
        or (m < 40 and ":#" in d)
        or (m < 16 and own_line and _digit_heavy(d))
        or (m < 5 and d[:2] not in ("{|", "|}") and not re.search(r"[A-Za-z]|[^\x00-\xbf]", d))
    )


def drop_debris(text: str) -> str:
    """Attribute lines anywhere, and data fields and fragments in template output; a segment ends at a break or mark."""
    out: list[str] = []
    blank, depth = 0, 0
    pieces = re.split("(\n|\x01|\x02)", text)
    for i in range(0, len(pieces), 2):
        seg, sep = pieces[i], pieces[i + 1] if i + 1 < len(pieces) else ""
        before = pieces[i - 1] if i else "\n"
        bare = seg.strip(" ")
        if bare:
            n = values.size(bare)
            own = before == "\n" and sep in ("\n", "")
            drop = (2 < n < 30 and _BARE.match(bare)) or (depth > 0 and _debris(bare, n, own))
            if not drop:
                blank = 0
                out.append(seg[2:] if depth and n > 2 and bare.startswith('" ') else seg)
                if sep == "\n":
                    out.append(sep)
        elif sep == "\n" or (not sep and seg):
            blank += 1
            if blank <= 2 and sep:
                out.append("\n")
        if sep in (A, Z):
            depth = max(0, depth + (1 if sep == A else -1))
            out.append(sep)
    return "".join(out).rstrip("\n ")


# cleanup ------------------------------------------------------------------


def _pre(text: str) -> str:
    text = re.sub(r"(?i)</?includeonly[^>]*>", "", text)
    text = re.sub(r"(?is)<noinclude\b[^>]*>.*?</noinclude\s*>|</?noinclude[^>]*>|<templatestyles[^>]*>|</?nowiki[^>]*>", "", text)
    return re.sub(rf"(?is)<({'|'.join(PRE_DROPPED)})\b(?:[^>]*/>|[^>]*>.*?</\1\s*>|[^>]*>)", "", text)


def _join_attributes(text: str) -> str:
    """Line breaks inside an unclosed quoted attribute of a table line."""
    lines, out = text.split("\n"), []
    for line in lines:
        if out and out[-1].lstrip(" \x01\x02")[:2] in ("{|", "|-") and out[-1].count('"') % 2 and line[:1] not in ("|", "!"):
            out[-1] += " " + line
        else:
            out.append(line)
    return "\n".join(out)


def _drop_tables(text: str) -> str:
    """Balanced tables at line starts go whole; an unclosed one ends at a blank line, a header or plain text."""
    out, depth, opened = [], 0, 0
    lines = text.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i].lstrip(" \x01\x02:")
        if line.startswith("{|"):
            if depth == 0:
                opened = i
            depth += 1
        elif depth and line.startswith("|}"):
            depth -= 1
            if depth == 0:
                rest = line[2:].strip()
                marks = "".join(_MARKS.findall("\n".join(lines[opened : i + 1])))
                while "\x01\x02" in marks:
                    marks = marks.replace("\x01\x02", "")
                out.append(marks + rest)
                i += 1
                continue
        if depth == 0:
            out.append(lines[i])
        i += 1
    if depth:  # never closed
        k = opened + 1
        while k < len(lines) and lines[k].strip(" \x01\x02") and lines[k].lstrip(" \x01\x02")[:1] in "|!{" and not lines[k].startswith("=="):
            k += 1
        out += lines[k:]
    return "\n".join(out)


def _cell(content: str, header: bool = False) -> str:
    """A cell without its attributes."""
    left, bar, right = content.partition("|")
    if bar and "[[" not in left and (header or "=" in left or ":" in left):
        return right.strip(" ")
    if not bar and "[[" not in content and re.match(r"\s*[\w-]+\s*[=:]", content) and "=" in content:
        return ""
    return content.strip(" ")


def _cells(line: str) -> str:
    body = line.lstrip(" ")
    marks = re.match("[\x01\x02]*", body)[0]
    body = body[len(marks) :]
    if body.startswith("|-"):
        return marks
    if body.startswith("|}"):
        return marks + body[2:]
    if body.startswith("|+"):
        return marks + _cell(body[2:])
    if body.startswith("|"):
        return marks + " ".join(_cell(c.lstrip("|")) for c in re.split(r"\|\|+", body.lstrip("|")))
    if body.startswith("!"):
        return marks + " ".join(_cell(c, True) for c in body.lstrip("!").split("!!"))
    if "||" in body:
        return marks + " ".join(_cell(c) for c in re.split(r"\|\|+", body))
    return line


_TRANSLATE = {**{c: " " for c in [0xA0, *range(0x2000, 0x200C), 0x202F, 0x205F, 0x3000]}, 0x2028: "\n", 0x2029: "\n", 0xFEFF: None}


def _strip_tags(text: str) -> str:
    def tag(m: re.Match) -> str:
        name = m[1].lower()
        if name in BLOCKS:
            before = _MARKS.sub("", text[max(0, m.start() - 3) : m.start()])[-1:]
            after = _MARKS.sub("", text[m.end() : m.end() + 3])[:1]
            if before and after and _wordish(before) and _wordish(after):
                return " "
        return ""

    return re.sub(r"</?([A-Za-z][A-Za-z0-9]*)?\b[^<>]{0,2000}?>|</[^<>]{0,2000}>", lambda m: tag(m) if m[1] else "", text)


def normal_space(text: str) -> str:
    """Blanks collapsed, lines trimmed, bars to blanks, at most two breaks in a row, tiny lines without letters dropped."""
    out: list[str] = []
    blank = 0
    for line in re.sub(r"[ \t\r\f\v|]+", " ", text).split("\n"):
        s = re.sub(r" (?=[\x01\x02]*\Z)", "", line.strip(" "))
        s = re.sub(r"^([\x01\x02]*) ", r"\1", s)
        bare = _MARKS.sub("", s)
        if 0 < values.size(bare) < 5 and not re.search(r"[A-Za-z]|[^\x00-\xbf]", bare):
            out.append("".join(_MARKS.findall(s)) + "\x00")  # the break goes too
            continue
        if not bare:
            blank += 1
            out.append(s if blank <= 1 else s + "\x00")
            continue
        blank = 0
        out.append(s)
    return re.sub("\x00\n?", "", "\n".join(out))


def _line_goes(s: str, n: int, template: bool) -> bool:
    """Whether a finished line is debris; ``template``: some of it came from a template."""
    low = s.lower()
    style = s.find('style="')
    if n > 10 and style >= 0 and any(p in s[style + 7 :] for p in STYLE_PROPERTIES):
        return True
    if n > 15 and any(x in s for x in MESSAGES):
        return True
    if n > 4 and "-->" in s and ("<!-" in s or "!--" in s):
        return True
    if template and n > 3 and (any(x in s for x in TABLE_ATTRIBUTES) or any(x in s for x in CSS) or 'class="' in s or 'style="' in s or "stroke-width" in s or "ExternalData" in s or '"geoshape"' in s or s[0] == '"'):
        return True
    if template and n < 16 and _digit_heavy(s):
        return True
    if low == "vcard" or any(low == x or low.startswith(x + " ") for x in LEAKED):
        return True
    if (n > 30 and any(x in s for x in ("mergedrow", "mergedtop", "ib-settlement"))) or (n > 10 and s.endswith(("nowrap", "noprint"))):
        return True
    if (n < 40 and s.endswith("=")) or (n > 1 and s.startswith('">')) or (n > 2 and s.endswith('">')):
        return True
    if ";" in s and re.search(r"(?<![a-z-])[a-z-]{3,}:|[a-z-]{3,}:", s):
        return True
    if s[0] == "!" or "colspan" in s[:20] or "rowspan" in s[:20]:
        return True
    if 5 < n < 80 and re.search(r'align="?(?:center|left|right)"?', s) and "align=" in s:
        return True
    if s.startswith("|-") or (s[0] == "-" and n > 1 and ("bgcolor" in s[:20] or "style=" in s[:20])):
        return True
    return bool(2 < n < 40 and re.match(r"(?=(?: *[a-z-]){2})[a-z -]*[=:]", s) and s.index(re.search(r"[=:]", s)[0]) >= 2)


def drop_lines(text: str) -> str:
    out, depth = [], 0
    for line in text.split("\n"):
        template = depth > 0 or bool(_MARKS.search(line))
        for c in _MARKS.findall(line):
            depth = max(0, depth + (1 if c == A else -1))
        s = _MARKS.sub("", line)
        bare = s.strip(" ")
        if bare and _line_goes(bare, values.size(bare), template):
            continue
        out.append(s)
    return "\n".join(out)


def clean(text: str) -> str:
    """Expanded, stripped text to its final form."""
    text = _join_attributes(_pre(text))
    text = re.sub(r"(?s)<!--.*?-->", "", text)
    text = re.sub(r"(?is)<ref\b[^>]*?/>|<ref\b[^>]*>.*?</ref\s*>", "", text)
    text = re.sub(rf"(?is)<({'|'.join(DROPPED)})\b[^>]*(?:/>|>.*?</\1\s*>)", "", text)
    text = _drop_tables(text)
    text = re.sub(r"(?i)<br[^>]*>", "\n", text)
    text = _strip_tags(text)
    text = re.sub(rf"(?i)\[(?:{'|'.join(SISTERS)}):[^\]]*\]", "", text)
    text = re.sub(r"(?i)\[(?://|http)[^\s\]]*(?: ([^\]]*))?\]", lambda m: m[1] or "", text)
    text = re.sub(r"''+", "", text)
    text = re.sub(r"(?m)^[\x01\x02]*=+[ \t]*(.*?)[ \t]*=+[ \t]*$", r"\n\1\n", text)
    text = "\n".join(_cells(x) if "|" in x or x.lstrip(" \x01\x02").startswith("!") or "!!" in x else x for x in text.split("\n"))
    text = re.sub(r"(?m)^([\x01\x02]*)-{4,}", r"\1\n", text)
    text = re.sub(r"(?m)^([\x01\x02 ]*)[*#:;]+ *", r"\1", text)
    text = re.sub(r"(?i)#invoke:[^\n\]}]*|#(?:ifeq|if|switch|expr):[^\n\]}|]*", "", text)
    text = re.sub(r"__[A-Z]{3,}__", "", text)
    text = normal_space(text.translate(_TRANSLATE)).rstrip(" \n")
    text = _strip_tags(html.unescape(text).translate(_TRANSLATE))
    return drop_lines(text)


def plain_text(expanded: str, namespaces: list[str] = (), compat: bool = False) -> str:
    """All passes, outer blanks off, marks removed."""
    text = clean(drop_debris(strip_markup(outer_marks(expanded), namespaces, compat)))
    return _MARKS.sub("", text).strip().encode("utf-8", "replace").decode()
