"""List counters: nine levels for each list, with starts, restarts and label templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import ROMAN

ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def cardinal(n: int) -> str:
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10] + ("-" + ONES[n % 10] if n % 10 else "")
    for size, word in ((1_000_000, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= size:
            return f"{cardinal(n // size)} {word}" + (f" {cardinal(n % size)}" if n % size else "")
    return str(n)


def ordinal_words(n: int) -> str:
    head, sep, last = cardinal(n).rpartition("-") if "-" in cardinal(n).split(" ")[-1] else cardinal(n).rpartition(" ")
    last = IRREGULAR.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th")
    return head + sep + last


def roman_digits(n: int) -> str:
    if not 1 <= n <= 32767:
        return str(n)
    out = ""
    for value, digits in ROMAN:
        out += digits * (n // value)
        n %= value
    return out


def repeated_letter(n: int, first: str, count: int, skip: str = "") -> str:
    letters = [chr(c) for c in range(ord(first), ord(first) + count + len(skip)) if chr(c) not in skip]
    return letters[(n - 1) % len(letters)] * min(1000, 1 + (n - 1) // len(letters)) if n >= 1 else str(n)


@lru_cache(1 << 16)
def number_text(n: int, kind: str) -> str:
    """A counter's text in a number format; unknown formats are decimal."""
    suffix = "th" if n % 100 in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
    rules = {
        "decimalZero": lambda: f"{n:02d}",
        "upperRoman": lambda: roman_digits(n),
        "lowerRoman": lambda: roman_digits(n).lower(),
        "upperLetter": lambda: repeated_letter(n, "A", 26),
        "lowerLetter": lambda: repeated_letter(n, "a", 26),
        "russianUpper": lambda: repeated_letter(n, "А", 29, "ЙЪЬ"),
        "russianLower": lambda: repeated_letter(n, "а", 29, "йъь"),
        "ordinal": lambda: f"{n}{suffix}",
        "cardinalText": lambda: cardinal(n).capitalize(),
        "ordinalText": lambda: ordinal_words(n).capitalize(),
        "decimalEnclosedCircle": lambda: chr(0x245F + n) if 1 <= n <= 20 else str(n),
        "decimalFullWidth": lambda: "".join(chr(0xFF10 + int(c)) if c.isdigit() else c for c in str(n)),
        "none": lambda: "",
    }
    return rules.get(kind, lambda: str(n))()


class Counters:
    """The state of one list. levels: {level: (start, format, text, restart_after, legal)}; overrides: {level: start}."""

    def __init__(self, levels: dict, overrides: dict | None = None):
        self.levels, self.overrides = levels, overrides or {}
        self.value, self.started = [0] * 9, [False] * 9
        self.parts: dict[int, list[str]] = {}

    def start_of(self, level: int) -> int:
        return self.overrides.get(level, (self.levels.get(level) or (1,))[0])

    def advance(self, level: int) -> None:
        self.value[level] = self.value[level] + 1 if self.started[level] else self.start_of(level)
        self.started[level] = True
        for deeper in range(level + 1, 9):
            after = (self.levels.get(deeper) or (1, "", "", None, False))[3]
            if after != 0 and level + 1 <= (deeper if after is None else after):
                self.started[deeper] = False

    def label(self, level: int) -> str:
        _, kind, text, _, legal = self.levels.get(level, (1, "decimal", f"%{level + 1}.", None, False))
        if kind == "bullet" or "%" not in text:
            return text
        if level not in self.parts:  # text and numbers of levels by turns
            self.parts[level] = re.split("%([1-9])", text)
        out = []
        for i, part in enumerate(self.parts[level]):
            if i % 2:
                k = int(part) - 1
                n = self.value[k] if self.started[k] else self.start_of(k)
                part = number_text(n, "decimal" if legal else (self.levels.get(k) or (1, "decimal"))[1])
            out.append(part)
        return "".join(out)


LABELS = "doc_id long, ord int, num_id int, level int, counter int, label string"


def list_labels(items: DataFrame, levels: DataFrame, by: str = "doc_id", advance: bool = True) -> DataFrame:
    """LABELS for list items (doc_id, ord, num_id, level); levels (num_id, level, start, format, text, restart_after, legal).

    A list is a document's; its items are scanned in order. Number 0 means no list. With advance=False the labels are those that
    the next item would be after, without counting it. Definitions with a column ``by`` are a document's own and meet its items in
    the shuffle, ahead of them; those without one, or null there, hold for all documents, and are few. A column start_override, if
    there is one, holds an instance's own starts.
    """
    fields = ["level", "start", "format", "text", "restart_after", "legal"]
    start = F.coalesce("start_override", "start") if "start_override" in levels.columns else F.col("start")
    known = levels.withColumns({"start": start.cast("int"), "legal": F.coalesce("legal", F.lit(False)), "restart_after": F.col("restart_after").cast("int")})
    shared: dict[int, dict] = {}
    for r in (known.where(F.col(by).isNull()) if by in levels.columns else known).collect():
        shared.setdefault(r["num_id"], {})[r["level"]] = tuple(r[c] for c in fields[1:])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, state = None, {}, Counters({})
        for b in batches:
            at, counters, labels = [], [], []
            docs, orders, nums, deep = (b.column(k).to_pylist() for k in range(4))
            rules = b.column(4)
            for i, (doc, num, level) in enumerate(zip(docs, nums, deep, strict=True)):
                if held != (doc, num):
                    held, own = (doc, num), {}
                    state = Counters(shared.get(num, {}))
                if (rule := rules[i].as_py() if rules[i].is_valid else None) is not None:
                    own[level] = tuple(rule[c] for c in fields[1:])
                    state = Counters(own)
                    continue
                if advance:
                    state.advance(level)
                at.append(i)
                counters.append(state.value[level] if state.started[level] else state.start_of(level))
                labels.append(state.label(level))
            if at:
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at)) for k in range(4)), pa.array(counters, pa.int32()), pa.array(labels, pa.string())], names=["doc_id", "ord", "num_id", "level", "counter", "label"])

    # A list's items stream by in order; its state is nine counters, however long it is.
    keys = lambda df, ord_: df.select(F.col(by).cast("long").alias("doc_id"), ord_.cast("int").alias("ord"), F.col("num_id").cast("int").alias("num_id"), F.col("level").cast("int").alias("level"), "rule")
    rule = F.struct(*(F.col(c) for c in fields[1:]))
    kind = known.select(rule.alias("rule")).schema["rule"].dataType.simpleString()
    rows = keys(items.where("num_id != 0").withColumn("rule", F.lit(None).cast(kind)), F.col("ord"))
    if by in levels.columns:
        rows = keys(known.where(F.col(by).isNotNull()).withColumn("rule", rule), F.lit(None)).unionByName(rows)
    return rows.repartition("doc_id", "num_id").sortWithinPartitions("doc_id", "num_id", F.col("ord").asc_nulls_first()).mapInArrow(scan, LABELS)
