"""Wikitext into a tree of calls, parameters and text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MAX_FRAMES = 64
MAX_PARTS = 256
_TOKEN = re.compile(r"\{{2,}|\}{2,}|\[\[|\]\]|\||<!--.*?-->|<(?P<tag>nowiki|math|ref|syntaxhighlight|source|pre)\b[^>]*?(?:/>|>.*?</(?P=tag)\s*>)", re.S | re.I)


@dataclass
class Node:
    kind: str  # "call" {{ }} or "param" {{{ }}}
    parts: list[list] = field(default_factory=lambda: [[]])
    links: int = 0

    def add(self, piece) -> None:
        part = self.parts[-1]
        if isinstance(piece, str) and part and isinstance(part[-1], str):
            part[-1] += piece
        elif piece != "":
            part.append(piece)


def _spill(node: Node) -> list:
    """An unclosed frame is literal text again."""
    out: list = ["{{" if node.kind == "call" else "{{{"]
    for i, part in enumerate(node.parts):
        out += (["|"] if i else []) + part
    return out


def parse(text: str) -> list:
    """Top-level pieces: strings and nodes."""
    root = Node("root")
    stack = [root]
    at = 0

    def close() -> None:
        node = stack.pop()
        stack[-1].add(node)

    for m in _TOKEN.finditer(text):
        stack[-1].add(text[at : m.start()])
        at = m.end()
        t = m.group()
        top = stack[-1]
        if t[0] == "{":
            n = len(t)
            widths = [2] * (n // 2) if n % 2 == 0 else [2] * (n // 2 - 1) + [3]
            for w in widths:
                if len(stack) > MAX_FRAMES:
                    stack[-1].add("{" * w)
                else:
                    stack.append(Node("param" if w == 3 else "call"))
        elif t[0] == "}":
            left = len(t)
            while left >= 2 and len(stack) > 1:
                if stack[-1].kind == "param":
                    if left < 3:
                        break
                    left -= 3
                else:
                    left -= 2
                close()
            stack[-1].add("}" * left)
        elif t == "[[":
            top.links += 1
            top.add(t)
        elif t == "]]":
            top.links = max(0, top.links - 1)
            top.add(t)
        elif t == "|" and len(stack) > 1 and not top.links and len(top.parts) < MAX_PARTS:
            top.parts.append([])
        else:
            top.add(t)
    stack[-1].add(text[at:])
    while len(stack) > 1:
        node = stack.pop()
        for piece in _spill(node):
            stack[-1].add(piece)
    return root.parts[0]


def source(pieces: list) -> str:
    """Wikitext of pieces again."""
    return "".join(p if isinstance(p, str) else "".join(("{{" if p.kind == "call" else "{{{", "|".join(source(x) for x in p.parts), "}}" if p.kind == "call" else "}}}")) for p in pieces)
