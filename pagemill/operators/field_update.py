"""Fields brought up to date: every instruction evaluated by its name, and the results put in place of the old ones.

Fields are rows (doc_id, ord, instruction), unique by document and ord, in document order. An unknown name, a missing property,
bookmark or variable and a formula that can't be evaluated give no result: the field is dirty and its old result stays.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions.formula import evaluate_formula
from pagemill.functions.pictures import date_format_of, numeric_picture
from pagemill.operators import fields as fields_of
from pagemill.operators.editing import set_results

KEY = ["doc_id", "ord"]
SWITCHES = ("Upper", "Lower", "Caps", "FirstCap")
NUMBERINGS = ("ROMAN", "roman", "ALPHABETIC", "alphabetic", "Arabic", "Ordinal", "Hex")
#: Names whose results come from what other fields made.
LATER = ("=", "REF")


def _formula_values(formula: Column, names: Column) -> Column:
    @F.pandas_udf("double")
    def run(formulas: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([None if f is None else evaluate_formula(f, {k: float(v) for k, v in (n or {}).items() if v is not None}) for f, n in zip(formulas, known, strict=True)], dtype="float64")

    return run(formula, names)


def _pictured(value: Column, picture: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series, pictures: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or pd.isna(v) else numeric_picture(v, p) for v, p in zip(values, pictures, strict=True)], dtype="object")

    return run(value, picture)


def _date_formats(picture: Column) -> Column:
    @F.pandas_udf("string")
    def run(pictures: pd.Series) -> pd.Series:
        known = lru_cache(1024)(date_format_of)
        return pd.Series([None if p is None else known(p) for p in pictures], dtype="object")

    return run(picture)


def _switched(text: Column, number: Column, general: Column) -> Column:
    r"""The general switch ``\*``: recasings of any result, spellings of numbers."""
    out = text
    for name in SWITCHES:
        out = F.when(F.lower(general) == name.lower(), T.general_switch(name, text)).otherwise(out)
    for name in NUMBERINGS:
        same = general == name if name.lower() in ("roman", "alphabetic") else F.lower(general) == name.lower()
        out = F.when(same & number.isNotNull(), T.general_switch(name, text, number)).otherwise(out)
    return out


def evaluate(fields: DataFrame, *, properties: DataFrame | None = None, variables: DataFrame | None = None, bookmarks: DataFrame | None = None, paragraphs: DataFrame | None = None, now: Column | None = None, names: tuple[str, ...] | None = None) -> DataFrame:
    """fields with name, result and dirty.

    properties: (doc_id, property, value), times as yyyy-MM-dd HH:mm:ss; variables: (doc_id, name, value); bookmarks: (doc_id, name,
    ord, start, length, text); paragraphs for STYLEREF: (doc_id, ord, style, text), the field's own paragraph in its column para.
    names: evaluate these alone; the others have neither result nor dirt. now: the time of DATE and TIME.
    """
    spark = fields.sparkSession
    f = fields.withColumn("__i", fields_of.instruction(F.col("instruction")))
    f = f.withColumns({"name": F.col("__i.name"), "args": F.col("__i.args")})
    arg = lambda k: F.get("args", F.lit(k))
    switch = lambda s: F.get(F.filter("__i.switches", lambda x: x["name"] == s), F.lit(0))["arg"]
    has = lambda s: F.exists("__i.switches", lambda x: x["name"] == s)
    f = f.withColumns({"__picture": switch("#"), "__date": switch("@"), "__general": F.get(F.filter(F.filter("__i.switches", lambda x: x["name"] == "*"), lambda x: ~F.lower(x["arg"]).isin("mergeformat", "charformat")), F.lit(0))["arg"], "__reset": switch("r").try_cast("int"), "__repeats": F.coalesce(has("c"), F.lit(False))})
    f = f.drop("__i")

    empty = lambda kind: spark.createDataFrame([], kind)
    f = fields_of.evaluate_properties(f, empty("doc_id long, property string, value string") if properties is None else properties, variables).drop("dirty").withColumnRenamed("result", "__known")

    seq = f.where("name = 'SEQ'").select(*KEY, arg(0).alias("__series"), F.col("__reset"), F.col("__repeats"))
    numbers = fields_of.sequence_numbers(seq, ["doc_id"], ["ord"], "__series", "__reset", "__repeats").select(*KEY, F.col("seq").cast("double").alias("__seq"))
    f = f.join(numbers, KEY, "left")

    if paragraphs is not None:
        marks = paragraphs.where("style is not null").select("doc_id", F.lower("style").alias("__s"), F.col("ord").cast("long").alias("__o"), F.col("text").alias("__t"), F.lit(None).cast("long").alias("ord"))
        refs = f.where("name = 'STYLEREF'").select("doc_id", F.lower(arg(0)).alias("__s"), F.col("para").cast("long").alias("__o"), F.lit(None).cast("string").alias("__t"), F.col("ord").cast("long").alias("ord"))
        nearest = fields_of.nearest_styled(marks.unionByName(refs), ["doc_id", "__s"], ["__o", F.col("ord").asc_nulls_first()], F.col("__t").isNotNull(), F.col("__t"))
        found = marks.unionByName(refs).withColumn("__styled", nearest).where("ord is not null").select("doc_id", "ord", "__styled")
        f = f.join(found, KEY, "left")
    else:
        f = f.withColumn("__styled", F.lit(None).cast("string"))

    if bookmarks is not None:
        refs = f.where("name = 'REF'").select(*KEY, F.lower(arg(0)).alias("__mark"))
        first = bookmarks.groupBy("doc_id", F.lower("name").alias("__mark")).agg(F.min_by(F.expr("substring(text, start + 1, length)"), F.struct("ord", "start")).alias("__ref"))
        f = f.join(refs.join(first, ["doc_id", "__mark"]).drop("__mark"), KEY, "left")
        known = first.select("doc_id", F.struct("__mark", T.to_number("__ref").alias("v")).alias("x")).where("x.v is not null")
        f = f.join(known.groupBy("doc_id").agg(F.map_from_entries(F.collect_list("x")).alias("__names")), "doc_id", "left")
    else:
        f = f.withColumns({"__ref": F.lit(None).cast("string"), "__names": F.lit(None).cast("map<string,double>")})

    formula = F.when(F.col("name") == "=", F.array_join("args", " "))
    f = f.withColumn("__value", F.coalesce(F.when(F.col("name") == "=", _formula_values(formula, F.col("__names"))), "__seq"))
    time = F.coalesce(F.when(F.col("name").isin("DATE", "TIME"), now if now is not None else F.current_timestamp()), F.when(F.col("name").isin("CREATEDATE", "SAVEDATE"), F.col("__known").try_cast("timestamp")))
    plain_date = F.when(F.col("name") == "TIME", "HH:mm").otherwise("yyyy-MM-dd")
    dated = F.when(time.isNotNull(), F.call_function("date_format", time, F.coalesce(_date_formats(F.col("__date")), plain_date)))
    chosen = F.lit(None).cast("string")
    for op in ("=", "<>", "!=", "<", "<=", ">", ">="):
        chosen = F.when(arg(1) == op, fields_of.if_field(arg(0), op, arg(2), F.coalesce(arg(3), F.lit("")), F.coalesce(arg(4), F.lit("")))).otherwise(chosen)
    numbered = F.coalesce(F.col("__value"), F.when(F.col("name").isin("NUMWORDS", "NUMCHARS", "NUMPAGES"), T.to_number("__known")))
    pictured = F.when(F.col("__picture").isNotNull(), _pictured(numbered, F.col("__picture")))
    text = F.coalesce(dated, F.when(F.col("name") == "IF", chosen), F.when(numbered.isNotNull(), F.coalesce(pictured, T.number_text(numbered))), "__styled", "__ref", "__known")
    result = _switched(text, numbered, F.col("__general"))
    wanted = F.lit(True) if names is None else F.col("name").isin(*names)
    done = f.withColumn("result", F.when(wanted, result)).withColumn("dirty", F.when(wanted, F.col("result").isNull()))
    return done.select(*fields.columns, "name", "result", "dirty")


def _moved(df: DataFrame, edits: DataFrame, start: str, length: str) -> DataFrame:
    """Places (doc_id, para, start, length) after results have been put in: edits (doc_id, para, result_start, delta)."""
    each = edits.groupBy("doc_id", "para").agg(F.collect_list(F.struct(F.col("result_start").alias("at"), "delta")).alias("__e"))
    total = lambda keep: F.coalesce(F.aggregate(F.transform(F.filter("__e", keep), lambda e: e["delta"]), F.lit(0), lambda a, x: a + x), F.lit(0))
    out = df.join(each, ["doc_id", "para"], "left")
    inside = total(lambda e: (e["at"] >= F.col(start)) & (e["at"] < F.col(start) + F.greatest(F.col(length), F.lit(1))))
    before = total(lambda e: e["at"] < F.col(start))
    return out.withColumns({start: F.col(start) + before, length: F.col(length) + inside}).select(df.columns)


def update(paras: DataFrame, fields: DataFrame, *, properties: DataFrame | None = None, variables: DataFrame | None = None, bookmarks: DataFrame | None = None, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, fields) with all results in place. paras: (doc_id, ord, text, style); fields also have para, result_start and
    result_length; bookmarks: (doc_id, name, para, start, length).

    What depends on texts alone comes first; then references and formulas, which read bookmarks over the new texts. A reference to
    a bookmark that itself holds a reference sees the result from before: call it again with what it returned.
    """
    columns = [*fields.columns, "name", "result", "dirty"]
    slim = fields.select(*fields.columns)
    first = evaluate(slim, properties=properties, variables=variables, paragraphs=paras, now=now)
    early, late = first.where(~F.col("name").isin(*LATER) | F.col("name").isNull()), first.where(F.col("name").isin(*LATER)).select(fields.columns)
    done = set_results(paras.withColumnRenamed("ord", "para"), early.select("doc_id", "para", "result_start", "result_length", "result"), ["doc_id", "para"])
    deltas = lambda df: df.where("result is not null").select("doc_id", "para", "result_start", (F.length("result") - F.col("result_length")).alias("delta"))
    late = _shifted(late, deltas(early))
    early = _shifted(early, deltas(early)).withColumn("result_length", F.coalesce(F.length("result"), "result_length"))
    marks = None
    if bookmarks is not None:
        marks = _moved(bookmarks, deltas(first.where(~F.col("name").isin(*LATER))), "start", "length").join(done.select("doc_id", "para", "text"), ["doc_id", "para"]).withColumnRenamed("para", "ord")
    second = evaluate(late, bookmarks=marks)
    done = set_results(done, second.select("doc_id", "para", "result_start", "result_length", "result"), ["doc_id", "para"])
    early = _shifted(early, deltas(second))
    second = _shifted(second, deltas(second)).withColumn("result_length", F.coalesce(F.length("result"), "result_length"))
    return done.withColumnRenamed("para", "ord").select(paras.columns), early.select(columns).unionByName(second.select(columns))


def _shifted(df: DataFrame, edits: DataFrame) -> DataFrame:
    """Results' starts after edits before them."""
    return _moved(df.withColumn("__none", F.lit(0)), edits, "result_start", "__none").drop("__none")


def document_statistics(paras: DataFrame) -> DataFrame:
    """Properties (doc_id, property, value) numwords, numchars (without white space) and numlines, from paragraphs (doc_id, text)."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    chars = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", ""))
    sums = paras.groupBy("doc_id").agg(F.sum(words).alias("numwords"), F.sum(chars).alias("numchars"), F.count(F.lit(1)).alias("numlines"))
    return sums.select("doc_id", F.explode(F.create_map(*(x for n in ("numwords", "numchars", "numlines") for x in (F.lit(n), F.col(n).cast("string"))))).alias("property", "value"))
