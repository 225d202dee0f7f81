"""A small expression language for row filters and derived columns, turned into columns by its own parser.

Grammar: or, and, not; comparisons (==, =, !=, <>, <, <=, >, >=, in [..]); + - * / % **; parentheses; numbers, quoted
strings, column names, and the functions abs, log, log2, log10, sqrt, exp, round, min, max. Anything else raises;
user text never reaches the SQL parser.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(\"[^\"]*\"|'[^']*')|(\*\*|==|!=|<>|<=|>=|[-+*/%()<>=,\[\]&|]))")
_CALLS = {"abs": F.abs, "log": lambda x: F.log(x), "log2": F.log2, "log10": F.log10, "sqrt": F.sqrt, "exp": F.exp, "round": lambda x: F.round(x), "min": F.least, "max": F.greatest}


class Parser:
    def __init__(self, text: str, columns: list[str]):
        self.columns, self.tokens, at = columns, [], 0
        text = text.rstrip()
        while at < len(text):
            if not (m := _TOKEN.match(text, at)):
                raise ValueError(f"unexpected {text[at:]!r}")
            kind = next(i for i in range(1, 5) if m[i] is not None)
            self.tokens.append((("number", "name", "text", "sign")[kind - 1], m[kind]))
            at = m.end()
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1].lower() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1].lower()
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise ValueError(f"{sign} expected")

    def parse(self) -> Column:
        out = self.either()
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self) -> Column:
        out = self.both()
        while self.take("or", "|"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.negated()
        while self.take("and", "&"):
            out = out & self.negated()
        return out

    def negated(self) -> Column:
        return ~self.negated() if self.take("not") else self.compared()

    def compared(self) -> Column:
        left = self.sum()
        if self.take("in"):
            self.need("[")
            items = [self.sum()]
            while self.take(","):
                items.append(self.sum())
            self.need("]")
            return left.isin(*items)
        if op := self.take("==", "=", "!=", "<>", "<", "<=", ">", ">="):
            right = self.sum()
            return {"==": left == right, "=": left == right, "!=": left != right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
        return left

    def sum(self) -> Column:
        out = self.product()
        while op := self.take("+", "-"):
            out = out + self.product() if op == "+" else out - self.product()
        return out

    def product(self) -> Column:
        out = self.power()
        while op := self.take("*", "/", "%"):
            right = self.power()
            out = out * right if op == "*" else F.try_divide(out.cast("double"), right.cast("double")) if op == "/" else out % right
        return out

    def power(self) -> Column:
        if self.take("-"):
            return -self.power()
        out = self.atom()
        return F.pow(out, self.power()) if self.take("**") else out

    def atom(self) -> Column:
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        if self.at >= len(self.tokens):
            raise ValueError("unexpected end")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return F.lit(float(text))
        if kind == "text":
            return F.lit(text[1:-1])
        if kind == "name" and text in self.columns:
            return F.col(f"`{text}`")
        if kind == "name" and text.lower() in _CALLS and self.take("("):
            items = [self.either()]
            while self.take(","):
                items.append(self.either())
            self.need(")")
            return _CALLS[text.lower()](*items)
        raise ValueError(f"unexpected {text!r}")


def expression(text: str, columns: list[str]) -> Column:
    return Parser(text, columns).parse()
