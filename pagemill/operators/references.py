"""Order and names of things that refer to each other: notes, anchors, styles, and what a merge leaves behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions.text import anchor_slug, label


def note_numbers(references: DataFrame, by: str = "doc_id") -> DataFrame:
    """references (by, pos, kind, id) of foot- and endnotes with number and name: one count over both kinds, by a note's first
    reference; later references to it share its number. Names are fn- or en- and the note's id."""
    first = references.groupBy(by, "kind", "id").agg(F.min("pos").alias("__first"))
    numbered = first.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy("__first", "kind", "id")))
    name = F.concat(F.when(F.col("kind") == "endnote", "en-").otherwise("fn-"), F.col("id").cast("string")).alias("name")
    return references.join(numbered.select(by, "kind", "id", "number"), [by, "kind", "id"]).select(*references.columns, "number", name)


def anchors(bookmarks: DataFrame, by: str = "doc_id") -> DataFrame:
    """bookmarks (by, name, ord) with anchor: the slug of its name, later ones of the same slug with a number from 1 behind it."""
    slug = bookmarks.withColumn("__slug", anchor_slug("name"))
    n = F.row_number().over(Window.partitionBy(by, "__slug").orderBy("ord", "name")) - 1
    return slug.withColumn("anchor", F.when(n == 0, F.col("__slug")).otherwise(F.concat("__slug", F.lit("-"), n.cast("string")))).drop("__slug")


def link_targets(links: DataFrame, registered: DataFrame, by: str = "doc_id") -> DataFrame:
    """links (by, target: a bookmark's name, maybe behind #) with the anchor of the first bookmark of that name in any case, else null."""
    first = registered.groupBy(by, F.lower("name").alias("__name")).agg(F.min_by("anchor", "ord").alias("anchor"))
    return links.withColumn("__name", F.lower(F.regexp_replace("target", "^#", ""))).join(first, [by, "__name"], "left").drop("__name")


def note_pairs(references: DataFrame, definitions: DataFrame, by: str = "page_id") -> DataFrame:
    """Web notes: references (by, ord, ref_id, href) and definitions (by, ord, def_id, backlink) that point at each other.

    Only a pair whose links go both ways counts; of several references to a definition, or definitions for a reference, the first.
    """
    ref = references.select(by, F.col("ord").alias("ref_ord"), "ref_id", F.regexp_replace("href", "^#", "").alias("def_id"))
    own = definitions.select(by, F.col("ord").alias("def_ord"), "def_id", F.regexp_replace("backlink", "^#", "").alias("ref_id"))
    pairs = ref.join(own, [by, "def_id", "ref_id"])
    one = pairs.withColumn("__n", F.row_number().over(Window.partitionBy(by, "def_id").orderBy("ref_ord", "def_ord"))).where("__n = 1")
    return one.withColumn("__n", F.row_number().over(Window.partitionBy(by, "ref_id").orderBy("def_ord"))).where("__n = 1").drop("__n")


def ordered_styles(styles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """styles with ord: by kind, then by id, so that the same styles are always written the same way."""
    kinds = F.array_position(F.array(*map(F.lit, ("paragraph", "character", "table", "numbering"))), F.col("type"))
    return styles.withColumn("ord", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.when(kinds == 0, 9).otherwise(kinds), "id")) - 1)


def left_behind(blocks: DataFrame, bound: Column, subject: Column, by: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(blocks that another document can take, diagnostics of those bound to their package): bound tells, subject names what stays."""
    gone = F.coalesce(bound, F.lit(False))
    notes = blocks.where(gone).select(by, F.lit("append").alias("op"), F.lit("left-behind").alias("kind"), subject.cast("string").alias("subject"), F.lit("bound to its package").alias("message"), "ord")
    return blocks.where(~gone), notes


def appended(target: DataFrame, source: DataFrame, by: str = "doc_id", start_on_new_page: bool = False, keep_sections: bool = True) -> DataFrame:
    """Blocks (by, ord, kind, text) of target with source's behind them: a page break between them if asked for, and section ends of source only if they are kept."""
    kept = source if keep_sections else source.where("kind != 'section' or kind is null")
    last = target.groupBy(by).agg(F.max("ord").alias("__last"))
    shift = F.coalesce(F.col("__last") + 1, F.lit(0)) + F.when(F.col("__last").isNotNull() & F.lit(start_on_new_page), 1).otherwise(0)
    out = target.unionByName(kept.join(last, by, "left").withColumn("ord", (F.col("ord") + shift).cast(target.schema["ord"].dataType)).select(target.columns))
    if start_on_new_page:
        breaks = last.join(kept.select(by).distinct(), by, "left_semi")
        made = {by: F.col(by), "ord": (F.col("__last") + 1).cast(target.schema["ord"].dataType), "kind": F.lit("page_break"), "text": F.lit("")}
        out = out.unionByName(breaks.select(*[made.get(c, F.lit(None).cast(target.schema[c].dataType)).alias(c) for c in target.columns]))
    return out


def first_definitions(definitions: DataFrame, by: str = "doc_id") -> DataFrame:
    """The first definition (by, ord, label, ...) of every label, in any case and spacing."""
    n = F.row_number().over(Window.partitionBy(by, label("label")).orderBy("ord"))
    return definitions.withColumn("__n", n).where("__n = 1").drop("__n")
