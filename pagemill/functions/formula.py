"""The formula language: a parser that compiles a literal formula into one Column expression, or evaluates one with plain numbers.

Anything that can't be evaluated (unknown names, division by zero, wrong counts of arguments) is null, never an error.

    comparison: sum [(= <> < <= > >=) sum]      sum: product {(+ -) product}      product: power {(* /) power}
    power: signed {^ signed}                    signed: - signed | [+] percent    percent: primary {%}
    primary: ( comparison ) | "number" | digits | name | name ( arguments, by , or ; )
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import to_number

TOKEN = re.compile(r'\s*(?:(\d[\d.]*|\.\d+)|("[^"]*")|([A-Za-z_][A-Za-z0-9_.:]*)|(<>|<=|>=|[=<>+\-*/^%(),;]))')
COMPARISONS: dict[str, Callable] = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
NULL = lambda kind: F.lit(None).cast(kind)


class NotEvaluable(ValueError):
    pass


def number(x: float) -> Column:
    return F.lit(float(x))


def flag(c: Column) -> Column:
    return c.cast("int").cast("double")


def truncated(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def rounded(x: Column, places: Column) -> Column:
    """Halves away from zero on the shortest decimal spelling; negative places cut to a whole number first."""
    places = F.least(truncated(places), F.lit(15.0)).cast("int")
    size = F.pow(F.lit(10.0), F.abs(places))
    fine = F.expr("0.0D") + F.signum(x) * F.floor(F.abs(x) * size + F.lit(0.5) + F.abs(x) * size * F.lit(2e-16)) / size
    rough = F.signum(x) * F.floor(F.abs(truncated(x)) / size + F.lit(0.5)) * size
    return F.when(places >= 0, fine).otherwise(rough)


def fold(kind: str, xs: list[Column]) -> Column:
    """A list function over its values; null if one of them is."""
    if not xs:
        return {"SUM": number(0), "COUNT": number(0), "PRODUCT": number(1)}.get(kind, NULL("double"))
    out = xs[0]
    for x in xs[1:]:
        out = out * x if kind == "PRODUCT" else out + x
    if kind == "AVERAGE":
        return out / len(xs)
    if kind == "COUNT":
        return F.when(out.isNotNull(), number(len(xs)))
    if kind in ("MIN", "MAX"):
        best = xs[0] if len(xs) == 1 else (F.least if kind == "MIN" else F.greatest)(*xs)
        return F.when(out.isNotNull(), best)
    return out


LISTS = ("AVERAGE", "COUNT", "MAX", "MIN", "PRODUCT", "SUM")
FUNCTIONS: dict[str, tuple[int, Callable]] = {
    "ABS": (1, F.abs),
    "INT": (1, truncated),
    "SIGN": (1, lambda x: F.signum(x)),
    "NOT": (1, lambda x: flag(x == 0)),
    "AND": (2, lambda a, b: flag((a != 0) & (b != 0))),
    "OR": (2, lambda a, b: flag((a != 0) | (b != 0))),
    "MOD": (2, lambda a, b: F.when(b != 0, a - truncated(a / F.nullif(b, number(0))) * b)),
    "ROUND": (2, rounded),
    "IF": (3, lambda c, a, b: F.when((c + a + b).isNotNull(), F.when(c != 0, a).otherwise(b))),
    "TRUE": (0, lambda: number(1)),
    "FALSE": (0, lambda: number(0)),
}


class Columns:
    """What the parser builds with: Columns."""

    number, fold = staticmethod(number), staticmethod(fold)
    functions = FUNCTIONS
    named = staticmethod(lambda x: x.cast("double"))
    text_number = staticmethod(lambda text: to_number(F.lit(text)))
    compare = staticmethod(lambda op, a, b: flag(COMPARISONS[op](a, b)))
    add, subtract = staticmethod(lambda a, b: a + b), staticmethod(lambda a, b: a - b)
    times, over = staticmethod(lambda a, b: a * b), staticmethod(lambda a, b: a / F.nullif(b, number(0)))
    power, minus = staticmethod(F.pow), staticmethod(lambda a: -a)
    known = staticmethod(lambda a: flag(a.isNotNull()))


def _strict(f: Callable) -> Callable:
    """f over numbers; null if an argument is, or if there is no finite result."""

    def run(*xs):
        if any(x is None for x in xs):
            return None
        try:
            out = float(f(*xs))
        except (ArithmeticError, ValueError, TypeError):
            return None
        return out if math.isfinite(out) else None

    return run


def _plain_rounded(x: float, places: float) -> float:
    places = int(min(math.trunc(places), 15))
    size = 10.0 ** abs(places)
    if places >= 0:
        return math.copysign(math.floor(abs(x) * size + 0.5 + abs(x) * size * 2e-16) / size, x)
    return math.copysign(math.floor(abs(math.trunc(x)) / size + 0.5) * size, x)


def _plain_text_number(text: str) -> float | None:
    text = text.strip().replace(",", "")
    return float(text) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", text) else None


def _plain_fold(kind: str, xs: list) -> float | None:
    if not xs:
        return {"SUM": 0.0, "COUNT": 0.0, "PRODUCT": 1.0}.get(kind)
    rules = {"SUM": lambda *v: sum(v), "AVERAGE": lambda *v: sum(v) / len(v), "COUNT": lambda *v: len(v), "MIN": min, "MAX": max, "PRODUCT": lambda *v: math.prod(v)}
    return _strict(rules[kind] if len(xs) > 1 or kind not in ("MIN", "MAX") else lambda v: v)(*xs)


class Numbers:
    """What the parser builds with: numbers, null where there is none."""

    fold = staticmethod(_plain_fold)
    number, named, text_number = staticmethod(float), staticmethod(lambda x: x), staticmethod(_plain_text_number)
    compare = staticmethod(lambda op, a, b: _strict(COMPARISONS[op])(a, b))
    add, subtract = staticmethod(_strict(lambda a, b: a + b)), staticmethod(_strict(lambda a, b: a - b))
    times, over = staticmethod(_strict(lambda a, b: a * b)), staticmethod(_strict(lambda a, b: a / b))
    power, minus = staticmethod(_strict(lambda a, b: math.pow(a, b))), staticmethod(_strict(lambda a: -a))
    known = staticmethod(lambda a: float(a is not None))
    functions: dict[str, tuple[int, Callable]] = {
        "ABS": (1, _strict(abs)),
        "INT": (1, _strict(math.trunc)),
        "SIGN": (1, _strict(lambda x: (x > 0) - (x < 0))),
        "NOT": (1, _strict(lambda x: x == 0)),
        "AND": (2, _strict(lambda a, b: a != 0 and b != 0)),
        "OR": (2, _strict(lambda a, b: a != 0 or b != 0)),
        "MOD": (2, _strict(lambda a, b: a - math.trunc(a / b) * b)),
        "ROUND": (2, _strict(_plain_rounded)),
        "IF": (3, _strict(lambda c, a, b: a if c != 0 else b)),
        "TRUE": (0, lambda: 1.0),
        "FALSE": (0, lambda: 0.0),
    }


class Compiler:
    """names: values by upper-case name; ranges: lists of values (cells) by upper-case name, for list functions; of, what they are."""

    of = Columns

    def __init__(self, formula: str, names: Mapping[str, Column] | None = None, ranges: Mapping[str, list[Column]] | None = None):
        self.names, self.ranges = names or {}, ranges or {}
        self.tokens, at, formula = [], 0, formula.rstrip()
        while at < len(formula):
            m = TOKEN.match(formula, at)
            if not m:
                raise NotEvaluable(formula)
            self.tokens.append(m[m.lastindex])
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        if self.peek() in wanted and self.peek():
            self.at += 1
            return self.tokens[self.at - 1]
        return ""

    def whole(self):
        out = self.comparison()
        if self.at < len(self.tokens):
            raise NotEvaluable("input is left over")
        return out

    def comparison(self):
        left = self.sum()
        if op := self.take(*COMPARISONS):
            return self.of.compare(op, left, self.sum())
        return left

    def sum(self) -> Column:
        out = self.product()
        while op := self.take("+", "-"):
            right = self.product()
            out = self.of.add(out, right) if op == "+" else self.of.subtract(out, right)
        return out

    def product(self) -> Column:
        out = self.power()
        while op := self.take("*", "/"):
            right = self.power()
            out = self.of.times(out, right) if op == "*" else self.of.over(out, right)
        return out

    def power(self) -> Column:
        out = self.signed()
        while self.take("^"):
            out = self.of.power(out, self.signed())
        return out

    def signed(self) -> Column:
        if self.take("-"):
            return self.of.minus(self.signed())
        self.take("+")
        return self.percent()

    def percent(self) -> Column:
        out = self.primary()
        while self.take("%"):
            out = self.of.over(out, self.of.number(100))
        return out

    def primary(self) -> Column:
        token = self.peek()
        if not token:
            raise NotEvaluable("an operand is missing")
        self.at += 1
        if token == "(":
            out = self.comparison()
            self.close()
            return out
        if token[0] == '"':
            return self.of.text_number(token[1:-1])
        if token[0].isdigit() or token[0] == ".":
            try:
                return self.of.number(float(token))
            except ValueError:
                raise NotEvaluable(token) from None
        name = token.upper()
        if self.take("("):
            return self.call(name)
        if name in ("TRUE", "FALSE"):
            return self.of.functions[name][1]()
        if name in self.names:
            return self.of.named(self.names[name])
        raise NotEvaluable(token)

    def close(self) -> None:
        if not self.take(")"):
            raise NotEvaluable("a bracket isn't closed")

    def call(self, name: str) -> Column:
        if name == "DEFINED":
            return self.defined()
        args: list[Column] = []
        if not self.take(")"):
            while True:
                if name in LISTS and self.peek().upper() in self.ranges:
                    args += self.ranges[self.peek().upper()]
                    self.at += 1
                else:
                    args.append(self.comparison())
                if not self.take(",", ";"):
                    break
            self.close()
        if name in LISTS:
            return self.of.fold(name, args)
        if name not in self.of.functions or self.of.functions[name][0] != len(args):
            raise NotEvaluable(name)
        return self.of.functions[name][1](*args)

    def defined(self) -> Column:
        try:
            out = self.comparison()
            self.close()
            return self.of.known(out)
        except NotEvaluable:
            depth = 1
            while depth and self.peek():
                depth += {"(": 1, ")": -1}.get(self.peek(), 0)
                self.at += 1
            return self.of.number(0)


def compile_formula(formula: str, names: Mapping[str, Column] | None = None, ranges: Mapping[str, list[Column]] | None = None) -> Column:
    """The formula's value as a double Column; null where it can't be evaluated."""
    try:
        return Compiler(formula.lstrip().removeprefix("="), {k.upper(): v for k, v in (names or {}).items()}, {k.upper(): v for k, v in (ranges or {}).items()}).whole()
    except NotEvaluable:
        return NULL("double")


class Evaluator(Compiler):
    of = Numbers


def evaluate_formula(formula: str, names: Mapping[str, float] | None = None, ranges: Mapping[str, list[float]] | None = None) -> float | None:
    """The formula's value for formulas that only rows know; None where it can't be evaluated."""
    try:
        return Evaluator(formula.lstrip().removeprefix("="), {k.upper(): v for k, v in (names or {}).items()}, {k.upper(): v for k, v in (ranges or {}).items()}).whole()
    except NotEvaluable:
        return None


def cell_reference(name: str) -> tuple[int, int] | None:
    """(row, column), from 1, of a name such as B3."""
    m = re.fullmatch(r"([A-Za-z]{1,3})([1-9]\d*)", name)
    if not m:
        return None
    column = 0
    for c in m[1].upper():
        column = column * 26 + ord(c) - 64
    return int(m[2]), column
