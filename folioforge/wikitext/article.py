"""One article from wikitext to text."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from . import cleanup
from .expand import Expander
from .magic import page_words

_REDIRECT = re.compile(r"(?i)^#REDIRECT(?:ION)?\s*\[\[([^\]]+)\]\]")


def redirect_target(wikitext: str) -> str | None:
    m = _REDIRECT.match(wikitext)
    return m[1].split("|")[0].split("#")[0].strip() if m else None


def render(wikitext: str | None, title: str = "", lookup: Callable[[str], str | None] | Mapping[str, str] = {}, words: Mapping[str, str] | None = None, namespaces: list[str] = (), compat: bool = False) -> str:
    """Plain text of an article; null and redirects give the empty text."""
    if not wikitext or redirect_target(wikitext) is not None:
        return ""
    find = lookup.get if isinstance(lookup, Mapping) else lookup
    magic = {**(words or {}), **page_words(title)}
    x = Expander(find, magic, compat=True)
    return cleanup.plain_text(x.text(cleanup.drop_extensions(wikitext)), namespaces, compat)
