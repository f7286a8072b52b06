"""Edits of a paragraph's text that move its runs, objects, marks and ranges along; builders and structure edits.

A paragraph is a row with text, and any of runs (start, length, format), objects (offset, ...), marks (offset, kind, ...) and ranges
(start, length, kind, ...), in code points. Edits are expressions over these columns: nothing is shuffled. A null text counts as
empty; positions are kept inside the text; a paragraph without one of the columns is edited without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.operators.styles import coalesce_runs

#: The character that stands for an object in a text.
OBJECT = "￼"
#: Kinds of marks that close something, and so go behind what replaces the text around them.
CLOSING = ("bookmark_end", "comment_end")


def spliced(paras: DataFrame, start: Column | int, count: Column | int, new: Column | str, format: Column | None = None) -> DataFrame:
    """paras with count code points from start replaced by new.

    New text has the given format, or that of the run at start (behind the text: of the last run). Objects inside the stretch go.
    Marks inside it move to its start, closing ones behind the new text. A range that began or ended inside reaches to the edges of
    the new text, so a range replaced as a whole covers what replaces it.
    """
    lit = lambda c: c if isinstance(c, Column) else F.lit(c)
    names = set(paras.columns)
    items = lambda c: F.coalesce(F.col(c), F.array().cast(paras.schema[c].dataType))
    size = F.length(F.coalesce("text", F.lit("")))
    p = paras.withColumns({"__new": lit(new), "__at": F.greatest(F.lit(0), F.least(lit(start).cast("int"), size))})
    p = p.withColumn("__end", F.col("__at") + F.greatest(F.lit(0), F.least(lit(count).cast("int"), size - F.col("__at"))))
    at, end, fresh = F.col("__at"), F.col("__end"), F.length("__new")
    delta = fresh - (end - at)
    out = {"text": F.concat(F.substring(F.coalesce("text", F.lit("")), F.lit(1), at), F.col("__new"), F.substring(F.coalesce("text", F.lit("")), end + 1, size))}
    if "runs" in names:
        runs = items("runs")
        last = lambda r: r["start"] + r["length"]
        here = F.coalesce(F.get(F.filter(runs, lambda r: at < last(r)), F.lit(0)), F.get(runs, F.size(runs) - 1))
        left = F.transform(F.filter(runs, lambda r: r["start"] < at), lambda r: r.withField("length", F.least(last(r), at) - r["start"]))
        right = F.transform(F.filter(runs, lambda r: last(r) > end), lambda r: r.withField("length", last(r) - F.greatest(r["start"], end)).withField("start", F.greatest(r["start"], end) + delta))
        kind = here["format"] if format is None else format
        own = F.when(fresh > 0, F.array(F.struct(at.alias("start"), fresh.alias("length"), kind.alias("format"))))
        out["runs"] = coalesce_runs(F.concat(left, F.coalesce(own, F.slice(runs, 1, 0)), right))
    if "objects" in names:
        kept = F.filter(items("objects"), lambda o: (o["offset"] < at) | (o["offset"] >= end))
        out["objects"] = F.transform(kept, lambda o: o.withField("offset", o["offset"] + F.when(o["offset"] >= end, delta).otherwise(0)))
    if "marks" in names:
        moved = lambda m: F.when(m["offset"] <= at, m["offset"]).when(m["offset"] >= end, m["offset"] + delta).when(m["kind"].isin(*CLOSING), at + fresh).otherwise(at)
        out["marks"] = F.transform(items("marks"), lambda m: m.withField("offset", moved(m)))
    if "ranges" in names:
        first = lambda r: F.when(r["start"] <= at, r["start"]).when(r["start"] >= end, r["start"] + delta).otherwise(at)
        stop = lambda x: F.when(x <= at, x).when(x < end, at + fresh).otherwise(x + delta)
        out["ranges"] = F.transform(items("ranges"), lambda r: r.withField("length", F.greatest(F.lit(0), stop(r["start"] + r["length"]) - first(r))).withField("start", first(r)))
    changed = (end > at) | (fresh > 0)
    return p.withColumns({k: F.when(changed, v).otherwise(F.col(k)) for k, v in out.items()}).select(*paras.columns)


def insert_text(paras: DataFrame, at: Column | int, text: Column | str, format: Column | None = None) -> DataFrame:
    return spliced(paras, at, 0, text, format)


def remove_text(paras: DataFrame, start: Column | int, count: Column | int) -> DataFrame:
    return spliced(paras, start, count, "")


def insert_object(paras: DataFrame, at: Column | int, item: Column) -> DataFrame:
    """An object (a struct like those of objects, its offset ignored) behind one character of its own."""
    place = F.greatest(F.lit(0), F.least((at if isinstance(at, Column) else F.lit(at)).cast("int"), F.length(F.coalesce("text", F.lit("")))))
    p = spliced(paras.withColumn("__place", place), F.col("__place"), 0, OBJECT)
    return p.withColumn("objects", F.array_sort(F.concat("objects", F.array(item.withField("offset", F.col("__place")))))).select(*paras.columns)


def append_text(paras: DataFrame, text: Column | str, format: Column | None = None) -> DataFrame:
    """Text at the end; a tab or a line break is the text of one."""
    return spliced(paras, F.length(F.coalesce("text", F.lit(""))), 0, text, format)


def append_object(paras: DataFrame, item: Column) -> DataFrame:
    return insert_object(paras, F.length(F.coalesce("text", F.lit(""))), item)


def apply_format(paras: DataFrame, start: Column | int, length: Column | int, transform) -> DataFrame:
    """The formats of a stretch transformed, its runs cut at its edges."""
    lit = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("int")
    size = F.length(F.coalesce("text", F.lit("")))
    at = F.greatest(F.lit(0), F.least(lit(start), size))
    end = at + F.greatest(F.lit(0), F.least(lit(length), size - at))

    def cut(r: Column) -> Column:
        last = r["start"] + r["length"]
        a, b = F.greatest(r["start"], F.least(at, last)), F.greatest(r["start"], F.least(end, last))
        part = lambda s, e: r.withField("start", s).withField("length", e - s)
        return F.array(part(r["start"], a), part(a, b).withField("format", transform(r["format"])), part(b, last))

    return paras.withColumn("runs", coalesce_runs(F.flatten(F.transform("runs", cut))))


def add_mark(paras: DataFrame, mark: Column) -> DataFrame:
    """A mark more, in order of places; those added later come later at one place."""
    before = F.filter("marks", lambda m: m["offset"] <= mark["offset"])
    return paras.withColumn("marks", F.concat(before, F.array(mark), F.filter("marks", lambda m: m["offset"] > mark["offset"])))


def add_range(paras: DataFrame, range_: Column) -> DataFrame:
    """A range more, kept inside the text."""
    size = F.length(F.coalesce("text", F.lit("")))
    at = F.greatest(F.lit(0), F.least(range_["start"], size))
    return paras.withColumn("ranges", F.concat("ranges", F.array(range_.withField("length", F.greatest(F.lit(0), F.least(range_["length"], size - at))).withField("start", at))))


def remove_where(paras: DataFrame, column: str, gone) -> DataFrame:
    """marks, ranges or objects without those for which gone(item) is true; the text stays."""
    return paras.withColumn(column, F.filter(column, lambda x: ~F.coalesce(gone(x), F.lit(False))))


def splice_all(paras: DataFrame, edits: Column) -> DataFrame:
    """Text alone, all edits (start, length, new) at once, from the last to the first, so that earlier places hold; overlapping ones are dropped in favour of the later place."""
    ordered = F.reverse(F.array_sort(F.transform(edits, lambda e: F.struct(e["start"].cast("int").alias("start"), e["length"].cast("int").alias("length"), e["new"].alias("new")))))
    start = F.struct(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.length(F.coalesce(F.col("text"), F.lit(""))).alias("limit"))

    def step(s: Column, e: Column) -> Column:
        fits = (e["start"] >= 0) & (e["start"] + e["length"] <= s["limit"])
        new = F.concat(F.substring(s["text"], F.lit(1), e["start"]), e["new"], F.substring(s["text"], e["start"] + e["length"] + 1, F.length(s["text"])))
        return F.struct(F.when(fits, new).otherwise(s["text"]).alias("text"), F.when(fits, e["start"]).otherwise(s["limit"]).alias("limit"))

    return paras.withColumn("text", F.when(F.size(edits) > 0, F.aggregate(ordered, start, step, lambda s: s["text"])).otherwise(F.col("text")))


def set_results(paras: DataFrame, results: DataFrame, by: list[str]) -> DataFrame:
    """Texts with fields' results (by, result_start, result_length, result) in place of the old ones; null results change nothing."""
    edits = results.where("result is not null").groupBy(*by).agg(F.collect_list(F.struct(F.col("result_start").alias("start"), F.col("result_length").alias("length"), F.col("result").alias("new"))).alias("__edits"))
    joined = paras.join(edits, by, "left")
    none = F.slice(F.col("__edits"), 1, 0)
    return splice_all(joined.withColumn("__edits", F.coalesce("__edits", none)), F.coalesce("__edits", F.from_json(F.lit("[]"), "array<struct<start:int,length:int,new:string>>"))).select(*paras.columns)


def add_comments(paras: DataFrame, comments: DataFrame, added: DataFrame, by: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(paragraphs, comments) with added (by, para_id, start, length, author, text): ids go on from each document's greatest, a range
    covers the commented stretch, and a reference character stands behind it, which later places make room for."""
    top = comments.groupBy(by).agg(F.max("id").alias("__top"))
    order = Window.partitionBy(by).orderBy("para_id", "start", "length", "text")
    fresh = added.join(top, by, "left").withColumn("id", (F.coalesce("__top", F.lit(-1)) + F.row_number().over(order)).cast("int"))
    rows = comments.unionByName(fresh.select(by, "id", F.lit(None).cast("int").alias("parent_id"), "author", "text"))
    each = fresh.groupBy(by, "para_id").agg(F.array_sort(F.collect_list(F.struct("start", "length", "id"))).alias("__c"))
    p = paras.join(each, [by, "para_id"], "left")
    # A comment's reference stands at its end; references of others that end earlier, or there with a lesser id, come before it.
    ends = F.transform("__c", lambda c: F.struct((c["start"] + c["length"]).alias("end"), c["id"].alias("id")))
    before = lambda place: F.size(F.filter(ends, lambda e: e["end"] <= place))
    own = F.transform("__c", lambda c: F.struct(
        (c["start"] + F.size(F.filter(ends, lambda e: e["end"] <= c["start"]))).cast("int").alias("start"),
        (c["length"] + F.size(F.filter(ends, lambda e: (e["end"] > c["start"]) & (e["end"] < c["start"] + c["length"])))).cast("int").alias("length"),
        F.lit("comment").alias("kind"), c["id"].alias("id")))
    old = F.transform("ranges", lambda r: F.struct((r["start"] + before(r["start"])).cast("int").alias("start"), (r["length"] + F.size(F.filter(ends, lambda e: (e["end"] > r["start"]) & (e["end"] < r["start"] + r["length"])))).cast("int").alias("length"), r["kind"].alias("kind"), r["id"].alias("id")))
    marked = splice_all(p, F.transform("__c", lambda c: F.struct((c["start"] + c["length"]).alias("start"), F.lit(0).alias("length"), F.lit(OBJECT).alias("new"))))
    some = F.col("__c").isNotNull()
    out = marked.withColumns({"ranges": F.when(some, F.concat(old, own)).otherwise(F.col("ranges"))})
    return out.select(*paras.columns), rows


def add_replies(comments: DataFrame, replies: DataFrame, by: str = "doc_id") -> DataFrame:
    """comments with replies (by, parent_id, author, text) to comments that exist; a reply to a reply joins its thread's first comment."""
    parents = comments.select(by, F.col("id").alias("parent_id"), F.coalesce("parent_id", "id").alias("__root"))
    top = comments.groupBy(by).agg(F.max("id").alias("__top"))
    order = Window.partitionBy(by).orderBy("parent_id", "text", "author")
    known = replies.join(parents, [by, "parent_id"]).join(top, by)
    return comments.unionByName(known.select(by, (F.col("__top") + F.row_number().over(order)).cast("int").alias("id"), F.col("__root").cast("int").alias("parent_id"), "author", "text"))


def add_notes(notes: DataFrame, added: DataFrame, by: str = "doc_id") -> DataFrame:
    """notes (by, kind, id, type, text) with added (by, kind, text): the first note of a kind in a document brings its two separators."""
    kinds = added.select(by, "kind").distinct().join(notes.select(by, "kind").distinct(), [by, "kind"], "left_anti")
    separators = kinds.select(by, "kind", F.explode(F.array(F.struct(F.lit(-1).alias("id"), F.lit("separator").alias("type")), F.struct(F.lit(0).alias("id"), F.lit("continuationSeparator").alias("type")))).alias("s"))
    top = notes.groupBy(by, "kind").agg(F.max("id").alias("__top"))
    order = Window.partitionBy(by, "kind").orderBy("text")
    fresh = added.join(top, [by, "kind"], "left").select(by, "kind", (F.greatest(F.coalesce("__top", F.lit(0)), F.lit(0)) + F.row_number().over(order)).cast("int").alias("id"), F.lit("normal").alias("type"), "text")
    return notes.unionByName(separators.select(by, "kind", "s.id", "s.type", F.lit("").alias("text"))).unionByName(fresh)


def insert_after(rows: DataFrame, new: DataFrame, by: list[str], order: str = "ord") -> DataFrame:
    """rows with new ones (their order column: the place they come after, -1 for the front) between them, numbered from 0 again.

    Serves blocks, table rows and sections alike; new rows of one place stay in the order of all their columns.
    """
    both = rows.withColumn("__new", F.lit(0)).unionByName(new.select(rows.columns).withColumn("__new", F.lit(1)))
    rest = [c for c in rows.columns if c not in (*by, order)]
    w = Window.partitionBy(*by).orderBy(order, "__new", *[c for c in rest if rows.schema[c].dataType.typeName() not in ("map", "variant")])
    return both.withColumn(order, (F.row_number().over(w) - 1).cast(rows.schema[order].dataType)).select(rows.columns)


def removed_rows(rows: DataFrame, gone: Column, by: list[str], order: str = "ord") -> DataFrame:
    """rows without those that gone holds for, numbered from 0 again."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.where(~F.coalesce(gone, F.lit(False))).withColumn(order, (F.row_number().over(w) - 1).cast(rows.schema[order].dataType))


def cloned(rows: DataFrame, chosen: Column, by: list[str], order: str = "ord") -> DataFrame:
    """rows with a copy behind each row that chosen holds for: a block, a table row or a section."""
    return insert_after(rows, rows.where(chosen), by, order)


def new_table(spark, table_id: int, rows: list[list[str]]) -> DataFrame:
    """Cells of a table from texts."""
    cells = [(table_id, r, c, 1, t) for r, row in enumerate(rows, 1) for c, t in enumerate(row, 1)]
    return spark.createDataFrame(cells, "table_id long, row_no int, cell_no int, grid_span int, text string")


def add_row(cells: DataFrame, by: list[str], texts: list[str]) -> DataFrame:
    """A row below the last of every table; cells beyond texts are empty, texts beyond the last row's cells make cells."""
    last = cells.groupBy(*by).agg(F.max(F.struct("row_no", "cell_no")).alias("m"))
    size = F.greatest(F.col("m.cell_no"), F.lit(len(texts)))
    new = last.select(*by, (F.col("m.row_no") + 1).alias("row_no"), F.posexplode(F.transform(F.sequence(F.lit(1), size), lambda k: F.coalesce(F.get(F.array(*map(F.lit, texts)) if texts else F.array().cast("array<string>"), k - 1), F.lit("")))).alias("p", "text"))
    return cells.unionByName(new.select(*by, "row_no", (F.col("p") + 1).alias("cell_no"), F.lit(1).alias("grid_span"), "text"))


def with_property(values: Column, name: str, value: Column | str) -> Column:
    """A map of variables or properties with one set; names ignore case, and the first spelling stays."""
    same = lambda k: F.lower(k) == name.lower()
    known = F.exists(F.map_keys(values), same)
    lit = value if isinstance(value, Column) else F.lit(value)
    changed = F.transform_values(values, lambda k, v: F.when(same(k), lit).otherwise(v))
    return F.when(known, changed).otherwise(F.map_concat(values, F.create_map(F.lit(name), lit)))


def property_of(values: Column, name: str) -> Column:
    return F.get(F.map_values(F.map_filter(values, lambda k, _: F.lower(k) == name.lower())), F.lit(0))


def without_property(values: Column, name: str) -> Column:
    return F.map_filter(values, lambda k, _: F.lower(k) != name.lower())


#: The marks of bullet lists and the formats of numbered ones, level by level, in turn.
BULLETS = ("•", "o", "▪")
NUMBERED = (("decimal", "%{}."), ("lowerLetter", "%{}."), ("lowerRoman", "%{}."))


def list_definition(spark, num_id: int, kind: str) -> DataFrame:
    """Nine levels (num_id, level, start, format, text, restart_after, legal) of a bullet, numbered or outline list."""
    rules = {
        "bullet": lambda k: ("bullet", BULLETS[k % 3]),
        "numbered": lambda k: (NUMBERED[k % 3][0], NUMBERED[k % 3][1].format(k + 1)),
        "outline": lambda k: ("decimal", ".".join(f"%{i + 1}" for i in range(k + 1)) + ("." if k == 0 else "")),
    }
    if kind not in rules:
        raise ValueError(f"no list is called {kind}")
    return spark.createDataFrame([(num_id, k, 1, *rules[kind](k), None, False) for k in range(9)], "num_id int, level int, start int, format string, text string, restart_after int, legal boolean")


def field_instruction(name: str, *args: str, **switches: str | None) -> str:
    """The text of a field: its name, its arguments in quotes where they need them, and its switches."""
    quoted = lambda a: '"' + a.replace("\\", "\\\\").replace('"', '\\"') + '"' if a == "" or any(c in a for c in ' "\\') else a
    spelled = {"number": "#", "date": "@", "general": "*"}
    return " ".join([name.upper(), *map(quoted, args), *(f"\\{spelled.get(k, k)}" + (f" {quoted(v)}" if v is not None else "") for k, v in switches.items())])
