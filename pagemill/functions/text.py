"""Text functions as Column expressions: everything stays inside Spark's code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pattern_of(pattern: str, regex: bool = False, match_case: bool = False, whole_word: bool = False) -> str:
    """A Java pattern for a search: literal unless regex; letters, digits and word edges are Unicode's."""
    if not pattern:
        raise ValueError("the pattern is empty")
    body = pattern if regex else "".join("\\" + c if c in r"\.[]{}()*+-?^$|&~#" else c for c in pattern)
    if whole_word:
        body = rf"\b(?:{body})\b"
    return ("(?U)" if match_case else "(?iuU)") + body


def utf16_offset(text: Column | str, offset: Column | str) -> Column:
    """A code point offset in UTF-16 units."""
    before = F.substring(col(text), F.lit(1), col(offset).cast("int"))
    return col(offset) + F.regexp_count(before, F.lit("[\\x{10000}-\\x{10FFFF}]"))


def collapse_space(text: Column | str) -> Column:
    """Runs of tab, line feed, form feed, carriage return and space become a space; leading space goes. No-break space stays."""
    return F.regexp_replace(F.regexp_replace(col(text), r"[\t\n\f\r ]+", " "), "^ ", "")


def line_feeds(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"\r\n?", "\n")


def html_escape(text: Column | str) -> Column:
    """Named references for the four markup characters, numbers for the apostrophe and U+00A0 to U+00FF."""
    out = col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    high = F.filter(F.array_distinct(F.split(F.regexp_replace(col(text), "[^ -ÿ]", ""), "")), lambda c: c != "")
    numbered = F.aggregate(high, out, lambda s, c: F.replace(s, c, F.concat(F.lit("&#"), F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10), F.lit(";"))))
    return F.when(F.size(high) > 0, numbered).otherwise(out)


def xml_escape(text: Column | str) -> Column:
    out = col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def markdown_escape(text: Column | str) -> Column:
    """Backslashes before characters that mark inline formatting, and before marks that would start a block."""
    inline = F.regexp_replace(col(text), r"([\\`*_\[\]<>|~])", r"\\$1")
    blocks = F.regexp_replace(inline, r"(?m)^( {0,3})(#{1,6}(?=\s|$)|[-+](?=\s|$)|=+\s*$|-{3,}\s*$)", r"$1\\$2")
    return F.regexp_replace(blocks, r"(?m)^( {0,3}\d{1,9})([.)])(?=\s|$)", r"$1\\$2")


def longest_run(text: Column | str, mark: str = "`") -> Column:
    runs = F.transform(F.regexp_extract_all(col(text), F.lit(f"({mark}+)"), F.lit(1)), lambda x: F.length(x))
    return F.coalesce(F.array_max(runs), F.lit(0))


def code_span(text: Column | str) -> Column:
    """text as a code span, its fence one longer than any run inside, padded where it starts or ends with a back-tick."""
    t = col(text)
    fence = F.repeat(F.lit("`"), longest_run(t) + 1)
    pad = F.when(t.startswith("`") | t.endswith("`"), F.lit(" ")).otherwise(F.lit(""))
    return F.concat(fence, pad, t, pad, fence)


def fence_length(text: Column | str) -> Column:
    return F.greatest(F.lit(3), longest_run(text) + 1)


def link_destination(url: Column | str) -> Column:
    """Null with control characters; in angle brackets where spaces or brackets would end it early."""
    u = col(url)
    angled = F.concat(F.lit("<"), F.regexp_replace(u, r"([<>\\])", r"\\$1"), F.lit(">"))
    return F.when(u.rlike(r"[\x00-\x1f\x7f]"), F.lit(None).cast("string")).when(u.rlike(r"[ ()<>]"), angled).otherwise(u)


def unsafe_link(url: Column | str) -> Column:
    return col(url).rlike(r"(?i)^\s*(javascript|vbscript|data):") | col(url).rlike(r"[\x00-\x1f\x7f]")


def anchor_slug(name: Column | str) -> Column:
    """bookmark, then the name's ASCII letters and digits in lower case, other stretches as one hyphen, none at the end."""
    return F.regexp_replace(F.concat(F.lit("bookmark"), F.lower(F.regexp_replace(col(name), "[^A-Za-z0-9]+", "-"))), "-+$", "")


def label(text: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.trim(col(text)), r"\s+", " "))


def on_off(value: Column | str) -> Column:
    v = F.lower(F.regexp_replace(col(value), r"^\s+|\s+$", ""))
    return F.when(v.isin("1", "true", "on"), F.lit(True)).when(v.isin("0", "false", "off"), F.lit(False))


def without_front_matter(text: Column | str) -> Column:
    """text without a first block between a line --- and a line --- or ...; an unclosed one stays."""
    return F.regexp_replace(col(text), r"(?s)\A---[ \t]*\n(?:.*?\n)??(?:---|\.\.\.)[ \t]*(?:\n|\z)", "")


def heading_level(line: Column | str) -> Column:
    return F.nullif(F.length(F.regexp_extract(col(line), r"^ {0,3}(#{1,6})(?:[ \t]|$)", 1)), F.lit(0))


def heading_text(line: Column | str) -> Column:
    body = F.regexp_extract(col(line), r"^ {0,3}#{1,6}(?:[ \t]+(.*))?$", 1)
    return F.regexp_replace(F.regexp_replace(body, r"(^|[ \t]+)#+[ \t]*$", ""), r"[ \t]+$", "")


def setext_level(line: Column | str) -> Column:
    return F.when(col(line).rlike(r"^ {0,3}=+[ \t]*$"), 1).when(col(line).rlike(r"^ {0,3}-+[ \t]*$"), 2)


def thematic_break(line: Column | str) -> Column:
    return col(line).rlike(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")


def fence_mark(line: Column | str) -> Column:
    """The opening fence of a code block, or null."""
    return F.nullif(F.regexp_extract(col(line), r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,})", 1), F.lit(""))


def list_marker(line: Column | str) -> Column:
    """struct(indent, mark, task, text) of a list item's line, or null."""
    rule = r"^( *)([-+*]|\d{1,9}[.)])(?:[ \t]+(?:\[([ xX])\][ \t]+)?(.*))?$"
    part = lambda k: F.regexp_extract(col(line), rule, k)
    found = F.struct(F.length(part(1)).alias("indent"), part(2).alias("mark"), F.nullif(part(3), F.lit("")).alias("task"), part(4).alias("text"))
    return F.when(col(line).rlike(rule) & ~thematic_break(line), found)


def pipe_cells(line: Column | str) -> Column:
    """Cells of a pipe-table row; a pipe after a backslash doesn't divide."""
    body = F.regexp_replace(F.trim(col(line)), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(body, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


def is_number(text: Column | str) -> Column:
    return F.trim(col(text)).rlike(r"^[+-]?(\d{1,3}(,\d{3})+|\d+|(?=\.\d))(\.\d*)?([eE][+-]?\d+)?$")


def to_number(text: Column | str) -> Column:
    """A cell's text as a number (thousands may have commas), else null."""
    return F.when(is_number(text), F.replace(F.trim(col(text)), F.lit(","), F.lit("")).try_cast("double"))


def caps(text: Column | str) -> Column:
    """The first character after every one that is no letter or digit in upper case; the others as they are."""
    chars = F.split(col(text), "")
    step = lambda s, c: F.struct(F.concat(s["out"], F.when(s["first"], F.upper(c)).otherwise(c)).alias("out"), (~c.rlike(r"^[\p{L}\p{N}]$")).alias("first"))
    return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(True).alias("first")), step, lambda s: s["out"])


def first_cap(text: Column | str) -> Column:
    """The first letter in upper case, everything after it in lower case."""
    head = F.regexp_extract(col(text), r"^(\P{L}*\p{L}?)", 1)
    return F.concat(F.upper(head), F.lower(F.substring(col(text), F.length(head) + 1, F.length(col(text)))))


def _whole(n: Column | str) -> Column:
    return F.bround(col(n), 0).cast("bigint")


ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def roman(n: Column | str) -> Column:
    """Roman digits of 1 to 32767, else plain ones."""
    whole, out, left = _whole(n), F.lit(""), _whole(n)
    for value, digits in ROMAN:
        out, left = F.concat(out, F.repeat(F.lit(digits), F.greatest(F.lit(0), F.floor(left / value)).cast("int"))), F.pmod(left, F.lit(value))
    return F.when(whole.between(1, 32767), out).otherwise(whole.cast("string"))


def alphabetic(n: Column | str) -> Column:
    """A to Z, AA, BB and so on, at most 1000 letters; plain digits below 1."""
    whole = _whole(n)
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.pmod(whole - 1, F.lit(26)) + 1).cast("int"), F.lit(1))
    return F.when(whole >= 1, F.repeat(letter, F.least(F.lit(1000), F.floor((whole - 1) / 26) + 1).cast("int"))).otherwise(whole.cast("string"))


def ordinal(n: Column | str) -> Column:
    whole = _whole(n)
    last, two = F.abs(whole) % 10, F.abs(whole) % 100
    end = F.when(two.between(11, 13), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(whole.cast("string"), end)


def hexadecimal(n: Column | str) -> Column:
    return F.hex(_whole(n))


def arabic(n: Column | str) -> Column:
    return _whole(n).cast("string")


def number_text(n: Column | str) -> Column:
    """A number without a picture: whole if it is within 1e-10 of one, else up to ten decimals."""
    v = col(n)
    near = F.abs(v - F.bround(v, 0)) < 1e-10
    decimals = F.regexp_replace(F.format_string("%.10f", v), r"\.?0+$", "")
    return F.when(v.isNull(), F.lit(None).cast("string")).when(near, _whole(v).cast("string")).otherwise(decimals)


SWITCHES = {"upper": F.upper, "lower": F.lower, "caps": caps, "firstcap": first_cap}
NUMBERINGS = {"arabic": arabic, "ordinal": ordinal, "hex": hexadecimal}


def general_switch(name: str, text: Column | str, number: Column | str | None = None) -> Column:
    r"""The ``\*`` switch called name; an unknown one changes nothing."""
    if name.lower() in SWITCHES:
        return SWITCHES[name.lower()](col(text))
    if number is not None:
        if name.lower() in ("roman", "alphabetic"):
            out = (roman if name.lower() == "roman" else alphabetic)(number)
            return out if name[0].isupper() else F.lower(out)
        if name.lower() in NUMBERINGS:
            return NUMBERINGS[name.lower()](number)
    return col(text)


#: Twips in each unit.
TWIPS = {"twip": 1.0, "pt": 20.0, "in": 1440.0, "cm": 1440 / 2.54, "mm": 144 / 2.54, "px": 15.0, "emu": 1 / 635}


def to_twips(value: Column | str, unit: str) -> Column:
    """Whole twips, halves away from zero."""
    return F.round(col(value) * TWIPS[unit]).cast("int")


def from_twips(twips: Column | str, unit: str) -> Column:
    return col(twips) / TWIPS[unit]


def packed_date(bits: Column | str) -> Column:
    """A 32-bit packed date (minute 6 bits, hour 5, day 5, month 4, years from 1900 9); null if it is none."""
    b = col(bits).cast("bigint")
    part = lambda shift, width: F.shiftright(b, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    text = F.format_string("%04d-%02d-%02d %02d:%02d:00", part(20, 9) + 1900, part(16, 4), part(11, 5), part(6, 5), part(0, 6))
    return F.when(b != 0, text.try_cast("timestamp_ntz"))
