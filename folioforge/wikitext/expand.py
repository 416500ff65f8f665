"""Template expansion with bounded depth, calls and size.

Output of every template is wrapped in ``\\x01`` ... ``\\x02`` so that later
passes know what did not stand in the article itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import quote

from . import values
from .expr import evaluate, expression
from .tree import Node, parse, source

MAX_DEPTH, MAX_CALLS, MAX_SIZE, MAX_NAME = 30, 50_000, 2_000_000, 4_095
BEGIN, END = "\x01", "\x02"
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_WRAPPER = re.compile(r"(?is)(?:\s|<!--.*?-->|<noinclude\b.*?</noinclude>|</?includeonly>)*\{\{(?:\s|<!--.*?-->|safesubst:|subst:)*#invoke:")
_BLANKS = " \t\r\n"


def normalize_title(name: str) -> str:
    """Outer blanks off, underscores and runs of blanks to one blank, first letter upper case."""
    s = re.sub(r"\s+", " ", name.replace("_", " ")).strip()
    return s[:1].upper() + s[1:]


def group_thousands(n: str) -> str:
    m = re.fullmatch(r"([+-]?)(\d+)((?:\.\d*)?)", n.strip())
    return f"{m[1]}{int(m[2]):,}{m[3]}" if m and (m[2][0] != "0" or len(m[2]) == 1) else re.sub(r"(?<=\d)(?=(?:\d{3})+$)", ",", m[2]).join((m[1], m[3])) if m else n


class Expander:
    """One article's expansion; ``lookup`` gives the body of a template by name or None."""

    def __init__(self, lookup: Callable[[str], str | None], magic: dict[str, str] | None = None, page_exists: Callable[[str], bool] | None = None, compat: bool = True) -> None:
        self.lookup, self.magic, self.exists, self.compat = lookup, magic or {}, page_exists, compat
        self.calls, self.bodies = 0, {}

    def text(self, wikitext: str) -> str:
        return self.run(parse(wikitext), {}, 0)

    def run(self, pieces: list, params: dict[str, str], depth: int, before: str = "\n") -> str:
        out: list[str] = []
        size = 0
        for p in pieces:
            if isinstance(p, str):
                piece = p
            elif p.kind == "param":
                piece = self.parameter(p, params, depth)
            elif depth >= MAX_DEPTH or self.calls >= MAX_CALLS or size > MAX_SIZE:
                piece = source([p])
            else:
                self.calls += 1
                tail = next((x for x in reversed(out) if x.strip(" \x01\x02")), before if not out else "")
                block = tail.rstrip(" \x01\x02").endswith("\n") or tail == "\n"
                piece = BEGIN + self.call(p, params, depth, block) + END
                piece = self._neutral(piece)
            out.append(piece)
            size += len(piece)
        return "".join(out)

    @staticmethod
    def _neutral(piece: str) -> str:
        """An opened comment inside a template's output must not swallow the article."""
        return piece if piece.rfind("<!--") <= piece.rfind("-->") else piece.replace("<!--", "<!- -")

    def parameter(self, node: Node, params: dict[str, str], depth: int) -> str:
        name = self.run(node.parts[0], params, depth).strip(_BLANKS)
        if name in params:
            return params[name]
        return self.run(node.parts[1], params, depth) if len(node.parts) > 1 else ""

    def call(self, node: Node, params: dict[str, str], depth: int, block: bool) -> str:
        name = _COMMENT.sub("", self.run(node.parts[0], params, depth + 1)).replace(BEGIN, "").replace(END, "").strip(_BLANKS)
        for prefix in ("safesubst:", "subst:"):
            if name.lower().startswith(prefix):
                name = name[len(prefix) :].strip(_BLANKS)
        word = self.magic.get(name, self.magic.get(name.upper()) if name.isascii() else None)
        if word is not None:
            return word
        head, colon, rest = name.partition(":")
        if colon:
            value = self.function(head.strip(_BLANKS).lower(), rest, node, params, depth)
            if value is not None:
                return value
            word = self.magic.get(head, self.magic.get(head.upper()))
            if word is not None:
                return word
            if head.upper() in ("DISPLAYTITLE", "DEFAULTSORT", "DEFAULTSORTKEY"):
                return ""
        name = name[:MAX_NAME]
        if name not in self.bodies:
            self.bodies[name] = self.lookup(name)
        body = self.bodies[name]
        if body is None:
            return self.fallback(node, params, depth, block, values.keep_missing, "\n")
        bound = self.bind(node, params, depth)
        result = self.run(parse(body), bound, depth + 1)
        if not result.strip(" \t\r\n\x01\x02") and _WRAPPER.match(body):
            return self.fallback(node, params, depth, block, values.keep_wrapper, " ")
        return result

    def named(self, part: list) -> tuple[str | None, list]:
        """Name and value of an argument; the first ``=`` outside calls divides them."""
        for i, p in enumerate(part):
            if isinstance(p, str) and "=" in p:
                a, b = p.split("=", 1)
                return source([*part[:i], a]).strip(_BLANKS), [x for x in [b, *part[i + 1 :]] if x != ""]
        return None, part

    def bind(self, node: Node, params: dict[str, str], depth: int) -> dict[str, str]:
        out, place = {}, 0
        for part in node.parts[1:]:
            name, value = self.named(part)
            if name is None:
                place += 1
                name = str(place)
            v = self.run(value, params, depth + 1)
            out[name] = v if "]]" in v else v.strip(_BLANKS)
        return out

    def fallback(self, node: Node, params: dict[str, str], depth: int, block: bool, keep, glue: str) -> str:
        kept = []
        for part in node.parts[1:]:
            name, value = self.named(part)
            if name is not None and len(name.encode()) < 40:
                if name.lower() in values.METADATA:
                    continue
                part = value
            raw = source(part).strip(_BLANKS)
            if raw and keep(raw, block):
                kept.append(self.run(parse(_COMMENT.sub("", raw)), params, depth + 1))
        return glue.join(kept)

    # parser functions: arguments are lazy, only the chosen branch is expanded

    def function(self, name: str, first: str, node: Node, params: dict[str, str], depth: int) -> str | None:
        act = _FUNCTIONS.get(name)
        if act is None:
            return None
        rest = node.parts[1:]
        return act(self, first, lambda i: self.run(rest[i], params, depth + 1).strip(_BLANKS) if i < len(rest) else "", len(rest), lambda i: self.run(rest[i], params, depth + 1) if i < len(rest) else "")


def _plain(s: str) -> str:
    return s.replace(BEGIN, "").replace(END, "")


def _number(s: str) -> float | None:
    try:
        return float(s[:63]) if s and "_" not in s else None
    except ValueError:
        return None


def _ifeq(x, first, arg, n, raw):
    a, b = first.strip(_BLANKS), _plain(arg(0))
    na, nb = _number(a), _number(b)
    return arg(1) if a == b or (na is not None and na == nb) else arg(2)


def _switch(x, first, arg, n, raw):
    key, falling, default = first.strip(_BLANKS), False, None
    for i in range(n):
        case = arg(i)
        left, eq, right = case.partition("=")
        left = _plain(left).strip(_BLANKS)
        if not eq:
            falling = falling or left == key
            if i == n - 1 and not x.compat and default is None:
                return case
        elif falling or left == key:
            return right.strip(_BLANKS)
        elif left == "#default":
            default = right.strip(_BLANKS)
    return default or ""


def _ifexist(x, first, arg, n, raw):
    if x.exists is not None:
        return arg(0) if x.exists(normalize_title(first)) else arg(1)
    return arg(1) if n >= 2 else arg(0) if x.compat else ""


def _iferror(x, first, arg, n, raw):
    return arg(0) if 'class="error"' in first else arg(1) if n >= 2 else first.strip(_BLANKS)


def _tag(x, first, arg, n, raw):
    name = first.strip(_BLANKS)
    return f"<{name}>{arg(0)}</{name}>"


def _formatnum(x, first, arg, n, raw):
    return first.strip(_BLANKS) if n and _plain(arg(0)).upper() in ("R", "NOSEP") else group_thousands(first.strip(_BLANKS))


def _pad(left: bool):
    def act(x, first, arg, n, raw):
        v, w = first.strip(_BLANKS), _plain(arg(0))
        fill = (_plain(arg(1)) if n > 1 else "") or "0"
        need = (int(w) if w.isdigit() else 0) - len(v.encode())
        return fill[0] * need + v if left and need > 0 else v + fill[0] * need if need > 0 else v

    return act


def _ascii(change):
    return lambda x, first, arg, n, raw: "".join(getattr(c, change)() if c.isascii() else c for c in first)


def _first_letter(change):
    return lambda x, first, arg, n, raw: (getattr(first[0], change)() if first[0].isascii() else first[0]) + first[1:] if first else ""


def _same(x, first, arg, n, raw):
    return first.strip(_BLANKS)


_FUNCTIONS = {
    "#if": lambda x, first, arg, n, raw: arg(0) if _plain(first).strip(_BLANKS) else arg(1),
    "#ifeq": _ifeq,
    "#switch": _switch,
    "#expr": lambda x, first, arg, n, raw: expression(_plain(first)),
    "#ifexpr": lambda x, first, arg, n, raw: arg(0) if evaluate(_plain(first)) else arg(1),
    "#ifexist": _ifexist,
    "#iferror": _iferror,
    "#invoke": lambda x, first, arg, n, raw: "",
    **dict.fromkeys(("#time", "#timel", "#dateformat", "#formatdate"), lambda x, first, arg, n, raw: arg(0)),
    **dict.fromkeys(("#titleparts", "#language", "ns", "nse", "localurl", "fullurl", "canonicalurl"), _same),
    "#tag": _tag,
    "formatnum": _formatnum,
    "lc": _ascii("lower"),
    "uc": _ascii("upper"),
    "lcfirst": _first_letter("lower"),
    "ucfirst": _first_letter("upper"),
    "urlencode": lambda x, first, arg, n, raw: quote(first.strip(_BLANKS), safe="-_.~"),
    "anchorencode": lambda x, first, arg, n, raw: first.strip(_BLANKS).replace(" ", "_"),
    "padleft": _pad(True),
    "padright": _pad(False),
    **dict.fromkeys(("#plural", "#grammar", "#gender", "plural", "grammar", "gender"), lambda x, first, arg, n, raw: next((v for v in map(arg, range(n)) if v), "")),
}
