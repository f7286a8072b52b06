"""Find, replace and highlight over paragraph rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import pattern_of

MATCHES = "array<struct<start:int,length:int,value:string>>"


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ord, text): a row for each line of each text."""
    return docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("ord", "text"))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, length, value), in code points from 0; places from running sums of gaps and matches."""
    whole = rf"(?s)\G(.*?)({pattern})"
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(whole), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(whole), F.lit(2)).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(MATCHES).alias("found"))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + F.length(x["gap"])
        one = F.struct(at.alias("start"), F.length(x["value"]).alias("length"), x["value"].alias("value"))
        return F.struct((at + F.length(x["value"])).alias("at"), F.concat(s["found"], F.array(one)).alias("found"))

    return F.when(text.rlike(pattern), F.aggregate(zipped, start, step, lambda s: s["found"])).otherwise(F.array().cast(MATCHES))


def find(paras: DataFrame, pattern: str, *, regex: bool = False, match_case: bool = False, whole_word: bool = False, text_col: str = "text", secondary_stories: bool = True) -> DataFrame:
    """paras' columns but text, with start, length and value: a row for each match. Without secondary stories, the body alone."""
    rule = pattern_of(pattern, regex, match_case, whole_word)
    if not secondary_stories and "story" in paras.columns:
        paras = paras.where("story = 'body'")
    hit = paras.where(F.col(text_col).rlike(rule)).select(*[c for c in paras.columns if c != text_col], F.explode(matches(F.col(text_col), rule)).alias("m"))
    return hit.select(*[c for c in hit.columns if c != "m"], "m.start", "m.length", "m.value")


def count_matches(text: Column, pattern: str, **options) -> Column:
    return F.regexp_count(text, F.lit(pattern_of(pattern, **options)))


def replace(paras: DataFrame, pattern: str, replacement: str, *, regex: bool = False, match_case: bool = False, whole_word: bool = False, text_col: str = "text") -> DataFrame:
    """paras with text replaced ($1 is a group if regex), and n_replaced."""
    rule = pattern_of(pattern, regex, match_case, whole_word)
    with_text = replacement if regex else replacement.replace("\\", "\\\\").replace("$", "\\$")
    return paras.withColumns({"n_replaced": F.regexp_count(text_col, F.lit(rule)), text_col: F.regexp_replace(text_col, rule, with_text)})


def highlight(paras: DataFrame, pattern: str, transform=lambda f: f.withField("highlight", F.lit("yellow")), *, regex: bool = False, match_case: bool = False, whole_word: bool = False) -> DataFrame:
    """paras (text, runs) with the matches' runs cut out and their format transformed; runs are (start, length, format)."""
    found = matches(F.col("text"), pattern_of(pattern, regex, match_case, whole_word))
    edges = F.flatten(F.transform(found, lambda m: F.array(m["start"], m["start"] + m["length"])))
    own = F.flatten(F.transform("runs", lambda r: F.array(r["start"], r["start"] + r["length"])))
    cuts = F.array_sort(F.array_distinct(F.concat(edges, own)))
    pieces = F.transform(F.slice(cuts, 1, F.greatest(F.size(cuts) - 1, F.lit(0))), lambda s, i: F.struct(s.alias("start"), (F.get(cuts, i + 1) - s).alias("length")))

    def styled(p: Column) -> Column:
        run = F.get(F.filter("runs", lambda r: (r["start"] <= p["start"]) & (p["start"] < r["start"] + r["length"])), F.lit(0))
        inside = F.exists(found, lambda m: (m["start"] <= p["start"]) & (p["start"] < m["start"] + m["length"]))
        return F.struct(p["start"].alias("start"), p["length"].alias("length"), F.when(inside, transform(run["format"])).otherwise(run["format"]).alias("format"))

    covered = F.filter(pieces, lambda p: F.exists("runs", lambda r: (r["start"] <= p["start"]) & (p["start"] < r["start"] + r["length"])))
    return paras.withColumns({"runs": F.transform(covered, styled), "n_highlighted": F.size(found)})


def splice(text: Column, start: Column, count: Column, new: Column) -> Column:
    """text with count code points from start replaced; both are kept inside the text."""
    at = F.greatest(F.lit(0), F.least(start, F.length(text)))
    n = F.greatest(F.lit(0), F.least(count, F.length(text) - at))
    return F.concat(F.substring(text, F.lit(1), at), new, F.substring(text, at + n + 1, F.length(text)))


def joined_text(blocks: DataFrame, by: list[str], text_col: str = "text", separator: str = "\n", order: str = "ord") -> DataFrame:
    """The texts of each group in order, joined; groups are documents or tables, whose size is that of their text."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))))
    return blocks.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), separator).alias("text"))
