"""Fields: instructions, sequences, references and conditions. What can't be evaluated is null, and dirty."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions.text import to_number

INSTRUCTION = "struct<name:string,args:array<string>,switches:array<struct<name:string,arg:string>>>"
#: Switches that take an argument.
WITH_ARGUMENT = {"#", "@", "*", "r", "s", "b", "f", "l", "t", "o"}
WORD = re.compile(r'\s*(?:"((?:[^"\\]|\\.)*)"|(\\[^\s"\\])|(\S+))')


def parse_instruction(text: str | None) -> dict | None:
    """Name, arguments and switches of a field instruction; quotes keep spaces, a backslash inside them escapes."""
    if not text or not text.strip():
        return None
    words = [(re.sub(r"\\(.)", r"\1", m[1]), False) if m[1] is not None else (m[2][1:], True) if m[2] else (m[3], False) for m in WORD.finditer(text)]
    name, args, switches, i = words[0][0], [], [], 1
    if name.startswith("=") and len(name) > 1:
        args, name = [name[1:]], "="
    while i < len(words):
        word, switch = words[i]
        i += 1
        if not switch:
            args.append(word)
        elif word.lower() in WITH_ARGUMENT and i < len(words) and not words[i][1]:
            switches.append({"name": word, "arg": words[i][0]})
            i += 1
        else:
            switches.append({"name": word, "arg": None})
    return {"name": name.upper(), "args": args, "switches": switches}


def instruction(text: Column) -> Column:
    """A field instruction's name, arguments and switches, as parse_instruction has them; all null for a blank one."""
    word = r'"(?:[^"\\]|\\.)*"'
    raw = F.regexp_extract_all(text, F.lit(word + r'|\\[^\s"\\]|\S+'), F.lit(0))
    switch = lambda w: w.rlike(r'^\\[^\s"\\]$')
    plain = lambda w: F.when(w.rlike("(?s)^" + word + "$"), F.regexp_replace(F.substring(w, F.lit(2), F.length(w) - 2), r"(?s)\\(.)", "$1")).otherwise(w)
    first = F.when(switch(raw[0]), F.substring(raw[0], F.lit(2), F.lit(1))).otherwise(plain(raw[0]))
    formula = first.startswith("=") & (F.length(first) > 1)
    none = F.array().cast("array<struct<name:string,arg:string>>")
    start = F.struct(F.when(formula, F.array(F.substring(first, F.lit(2), F.length(first)))).otherwise(F.array().cast("array<string>")).alias("args"), none.alias("switches"), F.lit(False).alias("wants"))

    def step(s: Column, w: Column) -> Column:
        last = F.get(s["switches"], F.size(s["switches"]) - 1)
        name = F.substring(w, F.lit(2), F.lit(1))
        named = F.struct(s["args"].alias("args"), F.concat(s["switches"], F.array(F.struct(name.alias("name"), F.lit(None).cast("string").alias("arg")))).alias("switches"), F.lower(name).isin(*WITH_ARGUMENT).alias("wants"))
        argued = F.struct(s["args"].alias("args"), F.concat(F.slice(s["switches"], F.lit(1), F.size(s["switches"]) - 1), F.array(F.struct(last["name"].alias("name"), plain(w).alias("arg")))).alias("switches"), F.lit(False).alias("wants"))
        added = F.struct(F.concat(s["args"], F.array(plain(w))).alias("args"), s["switches"].alias("switches"), F.lit(False).alias("wants"))
        return F.when(switch(w), named).when(s["wants"], argued).otherwise(added)

    read = F.aggregate(F.slice(raw, F.lit(2), F.size(raw) - 1), start, step)
    whole = F.struct(F.when(formula, "=").otherwise(F.upper(first)).alias("name"), read["args"].alias("args"), read["switches"].alias("switches"))
    blank = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("array<string>").alias("args"), F.lit(None).cast("array<struct<name:string,arg:string>>").alias("switches"))
    return F.when(F.coalesce(F.size(raw), F.lit(0)) > 0, whole).otherwise(blank)


def field_spans(marks: list[tuple[int, str]]) -> list[tuple[int, int | None, int]]:
    """(begin, separator, end) of nested fields from (offset, begin | separate | end) marks; unclosed ones are left out."""
    stack: list[list] = []
    out = []
    for at, kind in sorted(marks):
        if kind == "begin":
            stack.append([at, None])
        elif kind == "separate" and stack:
            stack[-1][1] = at
        elif kind == "end" and stack:
            begin, sep = stack.pop()
            out.append((begin, sep, at))
    return sorted(out)


def sequence_numbers(fields: DataFrame, doc: list[str], order: list, name: str = "seq_name", reset: str = "reset_to", repeat: str = "repeats") -> DataFrame:
    """Adds seq: the number of each SEQ field. A reset restarts its series, a repeat keeps the number before it; names ignore case."""
    series = Window.partitionBy(*doc, F.lower(name)).orderBy(*order)
    upto = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    with_group = fields.withColumn("__g", F.count(reset).over(upto))
    inside = Window.partitionBy(*doc, F.lower(name), "__g").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.sum(F.when(F.col(reset).isNull() & ~F.coalesce(F.col(repeat), F.lit(False)), 1).otherwise(0)).over(inside)
    return with_group.withColumn("seq", F.coalesce(F.first(reset).over(inside), F.lit(0)) + step).drop("__g")


def nearest_styled(rows: DataFrame, doc: list[str], order: list, style: Column, text: Column) -> Column:
    """The text of the nearest row with that style at or above, else the nearest below."""
    w = Window.partitionBy(*doc).orderBy(*order)
    hit = F.when(style, text)
    above = F.last(hit, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    below = F.first(hit, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return F.coalesce(above, below)


def compare(left: Column, op: str, right: Column) -> Column:
    """An IF field's comparison: as numbers if both are, else as text in any case."""
    a, b, x, y = to_number(left), to_number(right), F.upper(left), F.upper(right)
    numeric = a.isNotNull() & b.isNotNull()
    rules = {"=": lambda p, q: p == q, "<>": lambda p, q: p != q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q}
    if op not in rules:
        return F.lit(None).cast("boolean")
    return F.when(numeric, rules[op](a, b)).otherwise(rules[op](x, y))


def if_field(left: Column, op: str, right: Column, then: Column, other: Column) -> Column:
    return F.when(compare(left, op, right), then).otherwise(other)


def bookmark_text(refs: DataFrame, bookmarks: DataFrame, name: str = "name") -> DataFrame:
    """refs with the text of the first bookmark of that name in their document, in any case; null and dirty without one."""
    first = Window.partitionBy("doc_id", F.lower("name")).orderBy("ord", "start")
    own = bookmarks.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("doc_id", F.lower("name").alias("__name"), F.substring(F.col("text"), F.col("start") + 1, F.col("length")).alias("result"))
    joined = refs.withColumn("__name", F.lower(name)).join(own, ["doc_id", "__name"], "left").drop("__name")
    return joined.withColumn("dirty", F.col("result").isNull())


#: Fields whose results come from a document's properties (long form: doc_id, property, value).
PROPERTY_FIELDS = ("AUTHOR", "TITLE", "SUBJECT", "KEYWORDS", "COMMENTS", "LASTSAVEDBY", "FILENAME", "NUMWORDS", "NUMCHARS", "NUMPAGES", "CREATEDATE", "SAVEDATE", "USERNAME", "USERINITIALS", "USERADDRESS")


def evaluate_properties(fields: DataFrame, properties: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """fields (doc_id, name, args) with result and dirty: property fields, DOCPROPERTY, DOCVARIABLE, QUOTE and SET."""
    arg = F.lower(F.get("args", F.lit(0)))
    wanted = F.when(F.col("name").isin(*PROPERTY_FIELDS), F.lower("name")).when(F.col("name") == "DOCPROPERTY", arg)
    known = properties.select("doc_id", F.lower("property").alias("__p"), F.col("value").alias("__v")).dropDuplicates(["doc_id", "__p"])
    out = fields.withColumn("__p", wanted).join(known, ["doc_id", "__p"], "left")
    result = F.when(F.col("name") == "QUOTE", F.get("args", F.lit(0))).when(F.col("name") == "SET", F.lit("")).otherwise(F.col("__v"))
    if variables is not None:
        held = variables.select("doc_id", F.lower("name").alias("__q"), F.col("value").alias("__w")).dropDuplicates(["doc_id", "__q"])
        out = out.withColumn("__q", F.when(F.col("name") == "DOCVARIABLE", arg)).join(held, ["doc_id", "__q"], "left")
        result = F.when(F.col("name") == "DOCVARIABLE", F.col("__w")).otherwise(result)
    return out.withColumn("result", result).withColumn("dirty", F.col("result").isNull()).select(*fields.columns, "result", "dirty")
