"""Which parameter values of an unexpandable template are text worth keeping.

One predicate a rule; the three situations (template not found, wrapper around
a module, call left over after expansion) differ only in the rules they apply.
Lengths are bytes of UTF-8.
"""

from __future__ import annotations

import re

# Fixed values.
SWITCHES = set("oui non yes no true false left right center none auto".split())
LAYOUT = set("noredlink variant size check nocat hlist plainlist sidebar navbox transparent cellpadding cellspacing border nowrap colspan rowspan".split())
LANGUAGES = set("fr en de it es".split())
PARAMETER_WORDS = set("user nocat lang format style class width height align border thumb vignette redresse gauche droite upright frameless baseline verifierlesarguments".split())
METADATA = set("df cat bot date plural reason italic category pagetype fix-attempted".split())

_NUMBER = re.compile(r"[0-9.%px]*\Z")
_NUMBER_EM = re.compile(r"[0-9.%pxem]*\Z")
_WORD = re.compile(r"[A-Za-z_-]+\Z")
_IMAGE = re.compile(r"(?i)\.(?:jpg|png|svg|gif|jpeg|webp)\Z")
_CSS = re.compile(r"(?:[a-z-]{3,})[:;]|(?=[a-z-]*-)[a-z-]{3,}=")
_CSS_COLON = re.compile(r"[a-z-]{3,}:")
_CODE = re.compile(r"(?=.*-)(?=.*[0-9])[a-z0-9.%-]+\Z", re.S)
_ATTRIBUTE = re.compile(r"[A-Za-z-]{2,}=[\"']")
_LANG_TAG = re.compile(r"[a-z]{2,3}-[A-Z][a-z]{3}\Z")
_ISBN = re.compile(r"[0-9Xx-]{10,20}\Z")
_URL = re.compile(r"(?i)https?://.")
_NAMESPACE = re.compile(r"(?i)(?:category|catégorie|file|fichier|image):.")
_QUERY = re.compile(r"\?stroke|SELECT |WHERE ?\{|wd:|wdt:|geoshape|ExternalData")
_PROPERTY = re.compile(r"(?=.*-)[a-z-]{5,25}\Z")
_DIGIT = re.compile(r"[0-9٠-٩۰-۹०-९]")


def size(v: str) -> int:
    return len(v.encode())


def json_like(v: str) -> bool:
    return size(v) > 2 and v[0] in "{["


def is_prose(v: str, least_words: int) -> bool:
    """At least so many words and fewer than half digits; nested calls, tags and comments do not count."""
    v = re.sub(r"<!--.*?(?:-->|\Z)|<[^>]*>?", " ", v, flags=re.S)
    while (w := re.sub(r"\{\{(?:(?!\{\{|\}\}).)*\}\}", " ", v, flags=re.S)) != v:
        v = w
    chars = [c for c in v if not c.isspace()]
    return len(v.split()) >= least_words and len(_DIGIT.findall(v)) * 2 < len(chars)


def _common(v: str, n: int) -> bool:
    return (n <= 8 and v[:1] == "#") or bool(n < 40 and n >= 4 and _ATTRIBUTE.match(v))


def keep_missing(v: str, block: bool) -> bool:
    """Template not found."""
    n, low = size(v), v.lower()
    drop = (
        n < 2 or json_like(v) or low in SWITCHES or low in LAYOUT or _NUMBER_EM.match(v) or _common(v, n) or (_WORD.match(v) and (n <= 3 or (n <= 20 and low in PARAMETER_WORDS)))
        or (n > 4 and _IMAGE.search(v)) or (n < 40 and _CSS.search(v)) or (5 <= n < 40 and _CODE.match(v)) or _LANG_TAG.match(v)
    )
    return not drop and (not block or is_prose(v, 3))


def keep_wrapper(v: str, block: bool) -> bool:
    """Wrapper around a module that cannot run."""
    n, low = size(v), v.lower()
    drop = (
        n < 3 or json_like(v) or low in SWITCHES or low in LAYOUT or low in LANGUAGES or (n <= 3 and v.isascii() and v.isalpha()) or _NUMBER.match(v) or _common(v, n) or _ISBN.match(v)
        or re.search(r"(?i).\.(?:jpg|png|svg)\Z", v) or _URL.match(v) or _NAMESPACE.match(v) or (n > 20 and _QUERY.search(v)) or (n < 60 and _CSS.search(v)) or _PROPERTY.match(v) or (5 <= n < 40 and _CODE.match(v)) or _LANG_TAG.match(v)
    )
    return not drop and (not block or is_prose(v, 2))


def keep_leftover(v: str) -> bool:
    """Call still standing after expansion."""
    n, low = size(v), v.lower()
    return not (
        n < 2 or low in SWITCHES or _NUMBER_EM.match(v) or (n <= 8 and v[0] == "#") or (_WORD.match(v) and (n <= 3 or (n <= 20 and low in PARAMETER_WORDS - {"height", "align", "verifierlesarguments"})))
        or re.search(r"(?i).\.(?:jpg|png|svg|gif|jpeg)\Z", v) or (n >= 3 and v[0] == v[-1] == '"') or (n < 60 and "=" in v[:30] and '"' in v[:30]) or (n < 30 and ":#" in v)
        or (n < 40 and _CSS_COLON.search(v)) or "bgcolor" in v or "colspan" in v or "rowspan" in v
    )
