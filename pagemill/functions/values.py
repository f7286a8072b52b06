"""Property values as text, theme colours, hyphenation."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def property_text(kind: Column, value: Column) -> Column:
    """A typed property's value (its plain spelling in value) as text: whole and real numbers, true or false, times in UTC; empty for none."""
    stamp = F.date_format(F.to_utc_timestamp(value.try_cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rules = F.when(kind == "real", F.regexp_replace(value.try_cast("double").cast("string"), r"\.0$", "")).when(kind == "integer", value.try_cast("bigint").cast("string"))
    rules = rules.when(kind == "boolean", F.lower(value.try_cast("boolean").cast("string"))).when(kind == "date", stamp).when(kind == "empty", "").otherwise(value)
    return F.coalesce(rules, F.lit(""))


def _with_lightness(rgb: Column, change) -> Column:
    """A packed colour of the same hue and saturation with its lightness (0 to 1) changed."""
    red, green, blue = (F.shiftright(rgb, s).bitwiseAND(F.lit(255)) / F.lit(255.0) for s in (16, 8, 0))
    most, least = F.greatest(red, green, blue), F.least(red, green, blue)
    light = (most + least) / 2
    new = F.greatest(F.lit(0.0), F.least(F.lit(1.0), change(light)))
    span = most - least
    saturation = span / F.nullif(1 - F.abs(2 * light - 1), F.lit(0.0))
    # In this colour model a channel lies as far between least and most as before; only the span around the lightness changes.
    wide = (1 - F.abs(2 * new - 1)) * F.coalesce(saturation, F.lit(0.0))
    part = lambda c: F.round(255 * F.when(span < 1e-9, new).otherwise(new + wide * ((c - least) / F.nullif(span, F.lit(0.0)) - 0.5))).cast("int")
    return F.shiftleft(part(red), 16) + F.shiftleft(part(green), 8) + part(blue)


def tinted(rgb: Column, tint: Column) -> Column:
    """A colour lightened towards white; 255 changes nothing."""
    return _with_lightness(rgb, lambda x: x * (tint / F.lit(255.0)) + (1 - tint / F.lit(255.0)))


def shaded(rgb: Column, shade: Column) -> Column:
    """A colour darkened towards black; 255 changes nothing."""
    return _with_lightness(rgb, lambda x: x * (shade / F.lit(255.0)))


def theme_colour(slot: Column, tint: Column, shade: Column, scheme: Column, mapping: Column) -> Column:
    """A theme colour's value: the slot through the document's mapping to its scheme (maps), then shade, or else tint (0 or null: none); null for unknown slots."""
    rgb = F.element_at(scheme, F.coalesce(F.element_at(mapping, slot), slot)).cast("int")
    return F.when(F.coalesce(shade, F.lit(0)) != 0, shaded(rgb, shade)).when(F.coalesce(tint, F.lit(0)) != 0, tinted(rgb, tint)).otherwise(rgb)


class Hyphenator:
    """Liang's method: patterns with digits between their letters; odd values allow a break. Exceptions are words with hyphens."""

    def __init__(self, patterns: Iterable[str], exceptions: Iterable[str] = (), left: int = 2, right: int = 2):
        self.left, self.right = max(1, left), max(1, right)
        self.rules: dict[str, list[int]] = {}
        for p in patterns:
            letters = re.sub(r"\d", "", p)
            self.rules[letters] = self.values(p)
        self.longest = max(map(len, self.rules), default=0)
        self.exceptions = {e.replace("-", "").lower(): [i for i, c in self.places(e)] for e in exceptions}
        self.breaks = lru_cache(1 << 16)(self.found)

    @staticmethod
    def values(pattern: str) -> list[int]:
        out = [0]
        for c in pattern:
            if c.isdigit():
                out[-1] = int(c)
            else:
                out.append(0)
        return out

    @staticmethod
    def places(word: str) -> list[tuple[int, str]]:
        out, at = [], 0
        for c in word:
            if c == "-":
                out.append((at, c))
            else:
                at += 1
        return out

    def found(self, word: str) -> tuple[int, ...]:
        """Where word may be broken: counts of letters before."""
        low = word.lower()
        if low in self.exceptions:
            return tuple(self.exceptions[low])
        text = f".{low}."
        best = [0] * (len(text) + 1)
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + self.longest) + 1):
                for k, v in enumerate(self.rules.get(text[i:j], ())):
                    best[i + k] = max(best[i + k], v)
        return tuple(k for k in range(self.left, len(word) - self.right + 1) if best[k + 1] % 2)

    def hyphenated(self, text: str, mark: str = "­") -> str:
        def one(m: re.Match) -> str:
            word, cuts = m[0], self.breaks(m[0])
            return mark.join(word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)), strict=True))

        return re.sub(r"[^\W\d_]+", one, text)


def hyphenate(text: Column, patterns: list[str], exceptions: list[str] | None = None, left: int = 2, right: int = 2, mark: str = "­") -> Column:
    """text with mark wherever a word may be broken. The patterns of a language are a parameter, a few thousand at most."""
    rules, own = list(patterns), list(exceptions or [])

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        h = Hyphenator(rules, own, left, right)
        return pd.Series([None if t is None else h.hyphenated(t, mark) for t in texts], dtype="object")

    return run(text)
