"""Pointwise expressions in mathematical notation, as columns.

``sqrt(x1^2 + x2^2) * input - 3*other``: names are columns or given values, ``^`` and
``**`` raise to a power (right to left, before a sign), and the functions are those of
``FUNCTIONS``. Everything becomes built-in column functions, so plans stay in
generated code.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?)|([A-Za-z_]\w*)|(\*\*|[-+*/^(),]))")


def erf(x: Column) -> Column:
    """The error function: its power series near 0, a continued fraction beyond."""
    near, term = F.lit(0.0), None
    for n in reversed(range(36)):
        c = (-1.0) ** n / (math.factorial(n) * (2 * n + 1))
        near = F.lit(c) if term is None else F.lit(c) + near * x * x
        term = near
    near = near * x * F.lit(2 / math.sqrt(math.pi))
    a = F.abs(x)
    tail = a
    for n in reversed(range(1, 30)):
        tail = a + F.lit(n / 2.0) / tail
    far = F.signum(x) * (F.lit(1.0) - F.exp(-a * a) / (tail * F.lit(math.sqrt(math.pi))))
    return F.when(a < 2.5, near).otherwise(far)


#: Functions of one argument.
FUNCTIONS = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
    "exp": F.exp, "log": F.log, "sqrt": F.sqrt, "abs": F.abs, "sign": F.signum, "erf": erf,
    "erfc": lambda x: F.lit(1.0) - erf(x), "floor": F.floor, "ceil": F.ceil,
}


class _Parser:
    def __init__(self, text: str, names: dict[str, Column]):
        self.names, self.tokens, at = names, [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read {text[at:]!r}")
            self.tokens.append(m.group().strip())
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if not token or (wanted and token != wanted):
            raise ValueError(f"expected {wanted or 'a value'}, found {token or 'the end'}")
        self.at += 1
        return token

    def sum(self) -> Column:
        left = self.product()
        while self.peek() in ("+", "-"):
            left = left + self.product() if self.take() == "+" else left - self.product()
        return left

    def product(self) -> Column:
        left = self.signed()
        while self.peek() in ("*", "/"):
            left = left * self.signed() if self.take() == "*" else F.try_divide(left, self.signed())
        return left

    def signed(self) -> Column:
        if self.peek() in ("+", "-"):
            return self.signed() if self.take() == "+" else -self.signed()
        return self.power()

    def power(self) -> Column:
        base = self.value()
        if self.peek() in ("^", "**"):
            self.take()
            return F.pow(base, self.signed())
        return base

    def value(self) -> Column:
        token = self.take()
        if token == "(":
            inside = self.sum()
            self.take(")")
            return inside
        if token[0].isdigit() or token[0] == ".":
            return F.lit(float(token))
        if self.peek() == "(" and token in FUNCTIONS:
            self.take("(")
            inside = self.sum()
            self.take(")")
            return FUNCTIONS[token](inside).cast("double")
        if token in self.names:
            return self.names[token]
        if token == "pi":
            return F.lit(math.pi)
        raise ValueError(f"unknown name {token}")


def parse(text: str, names: dict[str, Column]) -> Column:
    p = _Parser(text, names)
    out = p.sum()
    if p.peek():
        raise ValueError(f"cannot read from {p.peek()!r} on")
    return out
