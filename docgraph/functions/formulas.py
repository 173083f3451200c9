"""The table formula language: ``Name [fmt] = expr; ...`` becomes a Column per formula.

Expressions have + - * / ( ), unary minus, numbers, columns (by header, quoted
header, or letter where no header has that letter), and the aggregates sum,
avg, min, max and count over a column's numeric cells. A formula may use the
columns that earlier ones computed. A division whose divisor is 0 gives null,
and a null result leaves the cell as it was.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

AGGREGATES = ("sum", "avg", "min", "max", "count")
TOKEN = re.compile(r"\s*(?:(?P<num>[\d.]+)|'(?P<quoted>[^']*)'?|(?P<op>[-+*/(),])|(?P<name>[^\s+\-*/(),]+))")
HEAD = re.compile(r"^(?P<name>.*?)\s*(?:\[(?P<fmt>[^\]]*)\])?$")


class FormulaError(ValueError):
    pass


@dataclass
class Formula:
    name: str
    fmt: str | None
    column: Column
    aggregates: bool
    bare: bool


def split_formulas(text: str) -> list[tuple[str, str | None, str]]:
    out = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        left, eq, right = part.partition("=")
        if not eq:
            raise FormulaError(f"bad formula: {part}")
        m = HEAD.match(left.strip())
        out.append((m["name"].strip().strip("'"), m["fmt"], right.strip()))
    return out


def aggregate(fn: str, column: Column, over=lambda c: c) -> Column:
    """Over numeric cells only; nothing to aggregate gives 0."""
    return F.coalesce(over(getattr(F, fn)(column)).cast("double"), F.lit(0.0))


class Translator:
    """Recursive descent over one expression; ``over`` wraps an aggregate (a window for row formulas).

    What a name, a number, a quotient and an aggregate give is left to methods,
    so that the same grammar also evaluates.
    """

    def __init__(self, text: str, columns: list[str], over=lambda c: c):
        self.columns, self.over, self.at = columns, over, 0
        self.tokens, pos = [], 0
        text = text.rstrip()
        while pos < len(text):
            m = TOKEN.match(text, pos)
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            pos = m.end()
        self.aggregates = self.bare = False

    def place(self, word: str) -> int:
        """Column of a header, or else of a letter; -1 where there is none."""
        if word in self.columns:
            return self.columns.index(word)
        return ord(word) - 65 if re.fullmatch("[A-Z]", word) and ord(word) - 65 < len(self.columns) else -1

    def name(self, word: str):
        at = self.place(word)
        if at < 0:
            raise FormulaError(f"unknown column `{word}`")
        return F.col(f"`{self.columns[at]}`")

    def number(self, word: str):
        return F.lit(float(re.match(r"\d*\.?\d*", word)[0] or 0))

    def quotient(self, a, b):
        return F.when(b != 0, a / F.when(b != 0, b))

    def reduced(self, fn: str, word: str):
        return aggregate(fn, self.name(word), self.over)

    def peek(self) -> tuple[str | None, str | None]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self) -> tuple[str | None, str | None]:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else (None, None)

    def parse(self):
        out = self.sum()
        if self.at < len(self.tokens):
            raise FormulaError("trailing tokens in formula")
        return out

    def sum(self):
        out = self.product()
        while self.peek() in (("op", "+"), ("op", "-")):
            op = self.take()[1]
            right = self.product()
            out = out + right if op == "+" else out - right
        return out

    def product(self):
        out = self.factor()
        while self.peek() in (("op", "*"), ("op", "/")):
            op = self.take()[1]
            right = self.factor()
            out = out * right if op == "*" else self.quotient(out, right)
        return out

    def factor(self):
        kind, word = self.take()
        if (kind, word) == ("op", "-"):
            return -self.factor()
        if (kind, word) == ("op", "("):
            out = self.sum()
            if self.take() != ("op", ")"):
                raise FormulaError("missing )")
            return out
        if kind == "num":
            return self.number(word)
        if kind == "name" and word.lower() in AGGREGATES and self.peek() == ("op", "("):
            self.take()
            inner_kind, inner = self.take()
            if inner_kind not in ("name", "quoted"):
                raise FormulaError(f"bad argument to {word}()")
            if self.take() != ("op", ")"):
                raise FormulaError("missing )")
            self.aggregates = True
            return self.reduced(word.lower(), inner)
        if kind in ("name", "quoted"):
            self.bare = True
            return self.name(word)
        raise FormulaError("unexpected end of formula" if kind is None else f"unexpected token `{word}`")


class Evaluator(Translator):
    """The same over arrays of cells (NaN where a cell is no number): ``failed`` is the first row that lacks one, and its column.

    Without ``rows`` there are only aggregates, as in a summary row.
    """

    def __init__(self, text: str, columns: list[str], cells: list[np.ndarray], rows: bool = True):
        super().__init__(text, columns)
        self.cells, self.rows, self.failed = cells, rows, None

    def name(self, word: str):
        at = self.place(word)
        if at < 0 or not self.rows:
            raise FormulaError(f"unknown column `{word}`")
        lacking = np.flatnonzero(np.isnan(self.cells[at]))
        if len(lacking) and (self.failed is None or lacking[0] < self.failed[0]):
            self.failed = int(lacking[0]), word
        return self.cells[at]

    def number(self, word: str):
        return float(re.match(r"\d*\.?\d*", word)[0] or 0)

    def quotient(self, a, b):
        return np.true_divide(a, b)

    def reduced(self, fn: str, word: str):
        at = self.place(word)
        if at < 0:
            raise FormulaError(f"unknown column `{word}`")
        own = self.cells[at][~np.isnan(self.cells[at])]
        if fn == "count":
            return float(len(own))
        return float({"sum": np.sum, "avg": np.mean, "min": np.min, "max": np.max}[fn](own)) if len(own) else 0.0


def translate(text: str, columns: list[str], over=lambda c: c) -> list[Formula]:
    out, known = [], list(columns)
    for name, fmt, expr in split_formulas(text):
        t = Translator(expr, known, over)
        column = t.parse()
        if t.aggregates and t.bare and name in expr and re.search(rf"\b(?:{'|'.join(AGGREGATES)})\(\s*'?{re.escape(name)}'?\s*\)", expr):
            raise FormulaError(f"{name} aggregates itself")
        out.append(Formula(name, fmt, column, t.aggregates, t.bare))
        if name not in known:
            known.append(name)
    return out
