"""Mathematical expressions in LaTeX: a parser to trees, and identity by values at seeded points.

Two expressions are the same when they agree at points drawn from a fixed seed, which no two different rational
expressions of modest degree do. The points are complex, so that roots and logarithms need no signs; where either side has no
value (a pole) the point is left out. Names stand for variables, but for the constants pi, e and i; a run of letters
is a product of single letters. Equations are the same when their differences are, up to a constant factor.
"""

from __future__ import annotations

import cmath
import functools
import random
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import ship

#: Points at which two expressions are compared, how near their values must be, and how large an expression may be.
POINTS, NEAR, LARGEST = 12, 1e-9, 4000

_FUNCTIONS: dict[str, Callable[[complex], complex]] = {
    "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "cot": lambda x: 1 / cmath.tan(x), "sec": lambda x: 1 / cmath.cos(x), "csc": lambda x: 1 / cmath.sin(x), "sinh": cmath.sinh, "cosh": cmath.cosh,
    "tanh": cmath.tanh, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "asin": cmath.asin, "acos": cmath.acos, "atan": cmath.atan, "exp": cmath.exp, "ln": cmath.log, "log": cmath.log,
    "sqrt": cmath.sqrt, "abs": abs,
}
_CONSTANTS = {"pi": complex(cmath.pi), "e": complex(cmath.e), "i": 1j}
_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?|\.\d+)|\\(?P<command>[A-Za-z]+)|\\(?P<space>[,;:! ])|(?P<word>[A-Za-z]+)|(?P<sign>\*\*|[-+*/^_(){}\[\]|=!]))")
#: Commands that only set how things look, and those that stand for a sign.
_LOOKS = {"left", "right", "displaystyle", "textstyle", "limits", "quad", "qquad", "big", "Big"}
_SIGNS = {"cdot": "*", "times": "*", "ast": "*", "div": "/"}

Node = tuple


class Unreadable(ValueError):
    """A text that is no expression."""


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.strip().strip("$").strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise Unreadable(text)
        at = m.end()
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind == "space" or kind == "command" and value in _LOOKS:
            continue
        if kind == "command" and value in _SIGNS:
            kind, value = "sign", _SIGNS[value]
        out.append(("sign", "^") if value == "**" else (kind, value))
    return out


class _Parser:
    """Sums of products of signed powers; two factors side by side are a product."""

    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end" or value is not None and token[1] != value:
            raise Unreadable(f"expected {value}, found {token[1]}")
        self.at += 1
        return token

    def whole(self) -> Node:
        left = self.sum()
        if self.peek() == ("sign", "="):
            self.take()
            left = ("equation", ("-", left, self.sum()))
        if self.peek()[0] != "end":
            raise Unreadable(self.peek()[1])
        return left

    def sum(self) -> Node:
        left = self.product()
        while self.peek() in (("sign", "+"), ("sign", "-")):
            left = (self.take()[1], left, self.product())
        return left

    def product(self) -> Node:
        left = self.signed()
        while True:
            kind, value = self.peek()
            if kind == "sign" and value in "*/":
                self.take()
                left = (value, left, self.signed())
            elif kind in ("number", "command", "word") or kind == "sign" and value in "({[":
                left = ("*", left, self.power())
            else:
                return left

    def signed(self) -> Node:
        if self.peek() in (("sign", "+"), ("sign", "-")):
            return ("neg", self.signed()) if self.take()[1] == "-" else self.signed()
        return self.power()

    def power(self) -> Node:
        base = self.atom()
        while self.peek() == ("sign", "!"):
            self.take()
            base = ("factorial", base)
        if self.peek() == ("sign", "^"):
            self.take()
            return ("^", base, self.exponent())
        return base

    def exponent(self) -> Node:
        if self.peek() in (("sign", "+"), ("sign", "-")):
            return ("neg", self.exponent()) if self.take()[1] == "-" else self.exponent()
        return self.power()

    def group(self) -> Node:
        """What a command takes as its argument: a group, or the next sign alone (one digit of a number)."""
        if self.peek() == ("sign", "{"):
            return self.bracketed("{", "}")
        kind, value = self.take()
        if kind in ("number", "word") and len(value) > 1:
            self.at -= 1
            self.tokens[self.at : self.at + 1] = [(kind, value[0]), (kind, value[1:])]
            self.at += 1
        if kind == "command":
            self.at -= 1
            return self.atom()
        return ("number", float(value[0])) if kind == "number" else self.named(value[0])

    def bracketed(self, opening: str, closing: str) -> Node:
        self.take(opening)
        inner = self.sum()
        self.take(closing)
        return inner

    def named(self, name: str) -> Node:
        return ("number", _CONSTANTS[name]) if name in _CONSTANTS else ("name", name)

    def atom(self) -> Node:
        kind, value = self.peek()
        if kind == "number":
            self.take()
            return ("number", float(value))
        if kind == "sign" and value in ("(", "{", "["):
            return self.bracketed(value, {"(": ")", "{": "}", "[": "]"}[value])
        if (kind, value) == ("sign", "|"):
            self.take()
            inner = self.sum()
            self.take("|")
            return ("call", "abs", inner)
        if kind == "command":
            return self.command()
        if kind == "word":
            self.take()
            if value in _FUNCTIONS:
                return self.call(value)
            if value == "pi":
                return self.named(value)
            # letters side by side are a product; the last may carry an index
            letters = [self.named(c) for c in value]
            if self.peek() == ("sign", "_"):
                letters[-1] = self.indexed(value[-1])
            if len(letters) > 1:  # a power binds to the last letter alone
                self.at -= 1
                self.tokens[self.at : self.at + 1] = [("word", c) for c in value] if len(value) > 1 else []
                return self.atom()
            return letters[0]
        raise Unreadable(value)

    def indexed(self, name: str) -> Node:
        self.take("_")
        begin = self.at
        self.group()
        return ("name", name + "_" + "".join(v for _, v in self.tokens[begin : self.at]))

    def command(self) -> Node:
        _, name = self.take()
        if name in ("frac", "dfrac", "tfrac"):
            top = self.group()
            return ("/", top, self.group())
        if name == "sqrt":
            if self.peek() == ("sign", "["):
                degree = self.bracketed("[", "]")
                return ("^", self.group(), ("/", ("number", 1.0), degree))
            return ("call", "sqrt", self.group())
        if name in ("text", "mathrm", "operatorname", "mathbf"):
            return self.group()
        if name in _FUNCTIONS:
            return self.call(name)
        if name == "pi":
            return self.named(name)
        return self.indexed(name) if self.peek() == ("sign", "_") else ("name", name)

    def call(self, name: str) -> Node:
        """A function, with a base or a power before its argument if it has one."""
        base = power = None
        while self.peek() in (("sign", "_"), ("sign", "^")):
            if self.take()[1] == "_":
                base = self.group()
            else:
                power = self.group() if self.peek() != ("sign", "-") else self.exponent()
        argument = self.power()
        if self.tokens[self.at - 1][1] not in (")", "}", "]", "|"):  # sin 2x is the sine of the product
            while self.peek()[0] in ("number", "word"):
                argument = ("*", argument, self.power())
        out: Node = ("call", name, argument)
        if base is not None:
            out = ("/", out, ("call", name, base))
        return out if power is None else ("^", out, power)


@functools.lru_cache(maxsize=4096)
def parsed(text: str) -> Node | None:
    """The tree of an expression; None where the text is none."""
    try:
        return _Parser(text).whole() if len(text) <= LARGEST else None
    except (Unreadable, RecursionError, KeyError, IndexError):
        return None


def names(node: Node) -> set[str]:
    if node[0] == "name":
        return {node[1]}
    return set().union(*(names(x) for x in node[1:] if isinstance(x, tuple)), set())


def value(node: Node, at: dict[str, complex]) -> complex:
    """The value of a tree where its names have those of ``at``; raises where it has none."""
    kind = node[0]
    if kind == "number":
        return complex(node[1])
    if kind == "name":
        return at[node[1]]
    if kind == "neg":
        return -value(node[1], at)
    if kind == "call":
        return complex(_FUNCTIONS[node[1]](value(node[2], at)))
    if kind == "equation":
        return value(node[1], at)
    if kind == "factorial":
        n = value(node[1], at)
        if n.imag or n.real < 0 or n.real != int(n.real) or n.real > 150:
            raise ValueError("factorial")
        return complex(functools.reduce(lambda a, b: a * b, range(1, int(n.real) + 1), 1))
    a, b = value(node[1], at), value(node[2], at)
    if kind == "+":
        return a + b
    if kind == "-":
        return a - b
    if kind == "*":
        return a * b
    if kind == "/":
        return a / b
    return a**b


def _values(node: Node, points: list[dict[str, complex]]) -> list[complex | None]:
    out: list[complex | None] = []
    for at in points:
        try:
            v = value(node, at)
            out.append(v if abs(v) < 1e100 else None)
        except (ValueError, ZeroDivisionError, OverflowError):
            out.append(None)
    return out


def equivalent(a: str | None, b: str | None) -> bool:
    """Whether two expressions are the same: equal numbers, or equal values at the seeded points. False where either cannot be read."""
    trees = [parsed(t) if t else None for t in (a, b)]
    if None in trees:
        return False
    free = sorted(names(trees[0]) | names(trees[1]))
    equations = [t[0] == "equation" for t in trees]
    if equations[0] != equations[1]:
        return False
    draw = random.Random(0)
    points = [{n: complex(draw.uniform(0.4, 2.2), draw.uniform(0.1, 0.9)) for n in free} for _ in range(POINTS if free else 1)]
    met = [(x, y) for x, y in zip(*(_values(t, points) for t in trees)) if x is not None and y is not None]
    if 2 * len(met) < len(points):
        return False
    if not free and not equations[0]:
        return abs(met[0][0] - met[0][1]) < NEAR
    if equations[0]:  # the same up to a factor
        x, y = met[0]
        return all(abs(x * v - y * u) <= NEAR * max(1.0, abs(x * v)) for u, v in met) and any(abs(u) > NEAR for u, _ in met) == any(abs(v) > NEAR for _, v in met)
    return all(abs(x - y) <= NEAR * max(1.0, abs(x), abs(y)) for x, y in met)


def same_expression(a: Column, b: Column) -> Column:
    """``equivalent`` of two columns (Arrow UDF); each distinct text is parsed once a worker, each distinct pair compared once a batch."""
    ship(SparkSession.active())

    @F.pandas_udf("boolean")
    def equal(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = list(zip(x, y))
        known = {p: equivalent(*p) for p in set(pairs)}
        return pd.Series([known[p] for p in pairs], dtype=bool)

    return equal(a, b)
