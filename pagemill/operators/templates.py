"""Templates: rows repeat over items, regions stay or go, placeholders take values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A template is a definition that a task holds whole.
MOST_LINES = 10_000
NAME = r"\{\{\s*([^{}]+?)\s*\}\}"


def anchors(text: Column) -> Column:
    """Placeholder names in order."""
    return F.regexp_extract_all(text, F.lit(NAME), F.lit(1))


def collection_of(name: Column) -> Column:
    """What stands before the first dot, or null."""
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", 1))


def member_of(name: Column) -> Column:
    return F.regexp_replace(name, r"^[^.]*\.", "")


def filled(text: Column, values: Column) -> Column:
    """text with its placeholders replaced from a map; unknown ones stay. Values are never searched for placeholders again."""
    gaps = F.split(text, NAME)
    names = anchors(text)
    raw = F.regexp_extract_all(text, F.lit(r"(\{\{\s*[^{}]+?\s*\}\})"), F.lit(1))
    parts = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.element_at(values, member_of(F.get(names, i))), F.get(raw, i), F.lit(""))))
    return F.array_join(parts, "")


def unresolved(text: Column, values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(anchors(text), lambda n: ~F.coalesce(F.map_contains_key(values, member_of(n)), F.lit(False)))))


def repeat_rows(rows: DataFrame, items: DataFrame, on: list[str]) -> DataFrame:
    """A copy of each template row for each item (on, item_no, values); no items, no rows."""
    return rows.join(items, on)


def keep_regions(regions: DataFrame, conditions: DataFrame, on: list[str]) -> DataFrame:
    """Regions (condition) whose condition is true or unknown; conditions: (on, condition, value)."""
    known = conditions.select(*on, F.col("condition"), F.col("value").alias("__value"))
    return regions.join(known, [*on, "condition"], "left").where(F.coalesce("__value", F.lit(True))).drop("__value")


def render(template: DataFrame, models: DataFrame, bindings: DataFrame, conditions: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """(model_id, text, unresolved) of every model; without lines that stay, its text is empty.

    template: (ord, text, collection, condition), a line each; bindings: (model_id, name, value); conditions: (model_id, condition,
    value); items: (model_id, collection, item_no, values map). Lines of a collection repeat for its items, whose values come
    before the model's.
    """
    rows = template.select("ord", "text", "collection", "condition").limit(MOST_LINES + 1).collect()
    if len(rows) > MOST_LINES:
        raise ValueError(f"a template has at most {MOST_LINES} lines")
    if not rows:
        return models.select("model_id", F.lit("").alias("text"), F.array().cast("array<string>").alias("unresolved"))
    texts = "map<string,string>"
    text = lambda x: F.lit(x).cast("string")
    lines = F.array(*[F.struct(F.lit(r["ord"]).cast("int").alias("ord"), text(r["text"]).alias("text"), text(r["collection"]).alias("collection"), text(r["condition"]).alias("condition")) for r in rows])
    own = models.select("model_id").join(bindings.groupBy("model_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("root")), "model_id", "left")
    # What belongs to a model meets in its row once; its lines are then made there, without a row for each.
    known = F.array().cast("array<struct<condition:string,value:boolean>>")
    if conditions is not None:
        own = own.join(conditions.groupBy("model_id").agg(F.collect_list(F.struct("condition", "value")).alias("known")), "model_id", "left")
        known = F.coalesce("known", known)
    held = F.array().cast(f"array<struct<collection:string,item_no:int,values:{texts}>>")
    if items is not None:
        own = own.join(items.groupBy("model_id").agg(F.collect_list(F.struct("collection", F.col("item_no").cast("int").alias("item_no"), "values")).alias("items")), "model_id", "left")
        held = F.coalesce("items", held)
    root = F.coalesce("root", F.create_map().cast(texts))
    stays = lambda x: x["condition"].isNull() | F.coalesce(F.get(F.filter(known, lambda k: k["condition"] == x["condition"]), F.lit(0))["value"], F.lit(True))

    def made(line: Column, number: Column, values: Column) -> Column:
        return F.struct(line["ord"].alias("ord"), number.alias("item_no"), filled(line["text"], values).alias("line"), unresolved(line["text"], values).alias("open"))

    def expanded(line: Column) -> Column:
        inside = F.transform(F.filter(held, lambda i: i["collection"] == line["collection"]), lambda i: made(line, i["item_no"], F.map_concat(F.map_filter(root, lambda k, v: ~F.map_contains_key(i["values"], k)), i["values"])))
        return F.when(line["collection"].isNull(), F.array(made(line, F.lit(0), root))).otherwise(inside)

    done = own.select("model_id", F.array_sort(F.flatten(F.transform(F.filter(lines, stays), expanded))).alias("lines"))
    return done.select("model_id", F.array_join(F.transform("lines", lambda p: p["line"]), "\n").alias("text"), F.array_sort(F.array_distinct(F.flatten(F.transform("lines", lambda p: p["open"])))).alias("unresolved"))


def binder(schema: T.StructType) -> dict[str, str]:
    """What each field of a model fills: boolean a condition, binary a picture, array of structs rows, anything else text."""
    kinds = {}
    for f in schema:
        name = f.metadata.get("name", f.name)
        if f.metadata.get("ignore"):
            continue
        rows = isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)
        kinds[name] = "condition" if isinstance(f.dataType, T.BooleanType) else "picture" if isinstance(f.dataType, T.BinaryType) else "rows" if rows else "text"
    return kinds


def formatted(c: Column, kind: T.DataType, form: str | None) -> Column:
    """A member's text: N2 and the like for numbers, date pictures for times."""
    if form and form[0] in "Nn" and form[1:].isdigit():
        return F.format_number(c, int(form[1:]))
    if form and isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        from pagemill.functions.pictures import date_picture

        return date_picture(c, form)
    return c.cast("string")
