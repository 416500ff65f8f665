"""Arithmetic of ``#expr``: precedence climbing over a token list."""

from __future__ import annotations

import math
import operator
import re

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(<=|>=|!=|==|[-+*/^()<>])|([A-Za-z]+))")
_UNARY = {"ceil": math.ceil, "floor": math.floor, "trunc": math.trunc, "abs": abs, "exp": math.exp, "ln": lambda x: math.log(x) if x > 0 else float("nan"), "sin": math.sin, "cos": math.cos, "tan": math.tan}
_CONST = {"pi": math.pi, "e": math.e}
# operator: level (loosest 1), right-associative, action
_BINARY = {
    "or": (1, False, lambda a, b: float(bool(a) or bool(b))),
    "and": (2, False, lambda a, b: float(bool(a) and bool(b))),
    "<=": (3, False, lambda a, b: float(a <= b)),
    ">=": (3, False, lambda a, b: float(a >= b)),
    "!=": (3, False, lambda a, b: float(a != b)),
    "==": (3, False, lambda a, b: float(a == b)),
    "<": (3, False, lambda a, b: float(a < b)),
    ">": (3, False, lambda a, b: float(a > b)),
    "+": (4, False, operator.add),
    "-": (4, False, operator.sub),
    "*": (5, False, operator.mul),
    "/": (5, False, lambda a, b: a / b if b else 0.0),
    "div": (5, False, lambda a, b: a / b if b else 0.0),
    "mod": (5, False, lambda a, b: math.fmod(a, b) if b else 0.0),
    "^": (6, True, lambda a, b: _power(a, b)),
}


def _power(a: float, b: float) -> float:
    try:
        v = a**b
        return v if isinstance(v, float) else float("nan")
    except (OverflowError, ZeroDivisionError):
        return float("inf")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while m := _TOKEN.match(text, at):
        kind = "num" if m[1] else "op" if m[2] else "word"
        value = m[m.lastindex]
        if kind == "word" and value.lower().startswith("and") and value.lower() != "and":
            value, kind = "and", "word"  # "and" needs no boundary after it
            at = m.start(3) + 3
        else:
            at = m.end()
        out.append((kind, value.lower() if kind == "word" else value))
    return out


class _Parser:
    """What cannot be parsed reads as 0 and ends the expression there."""

    def __init__(self, text: str) -> None:
        self.t, self.i = _tokens(text), 0

    def peek(self) -> str | None:
        return self.t[self.i][1] if self.i < len(self.t) else None

    def climb(self, level: int) -> float:
        left = self.unary()
        while (op := self.peek()) in _BINARY and _BINARY[op][0] >= level:
            rank, right, act = _BINARY[op]
            self.i += 1
            other = self.climb(rank if right else rank + 1)
            try:
                left = float(act(left, other))
            except (OverflowError, ValueError):
                left = float("nan")
        return left

    def unary(self) -> float:
        if self.i >= len(self.t):
            return 0.0
        kind, value = self.t[self.i]
        if value in "+-" and kind == "op":
            self.i += 1
            v = self.unary()
            return -v if value == "-" else v
        if value == "(":
            self.i += 1
            v = self.climb(1)
            if self.peek() == ")":
                self.i += 1
            return v
        if kind == "num":
            self.i += 1
            return float(value)
        if value in _UNARY:
            self.i += 1
            try:
                return float(_UNARY[value](self.unary()))
            except (OverflowError, ValueError):
                return float("nan")
        if value in _CONST:
            self.i += 1
            return _CONST[value]
        return 0.0


def evaluate(text: str) -> float:
    return _Parser(text).climb(1)


def show(x: float) -> str:
    """Integral values below 1e15 in full, others with six significant digits."""
    if math.isfinite(x) and x == math.trunc(x) and abs(x) < 1e15:
        return f"{x:.0f}"
    return f"{x:g}"


def expression(text: str) -> str:
    return show(evaluate(text))
