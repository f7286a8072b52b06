"""Tracked changes as rows: segments (doc_id, para, seg, kind, text) with kind null, ins, del, from or to; marks on paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def removed(kind: Column, accept: bool) -> Column:
    return F.coalesce(kind.isin(*(("del", "from") if accept else ("ins", "to"))), F.lit(False))


def resolve(segments: DataFrame, marks: DataFrame, accept: bool = True) -> DataFrame:
    """(doc_id, para, text): every paragraph after accepting or rejecting all changes.

    marks: (doc_id, para, mark) for every paragraph, mark null, ins or del. A paragraph whose end goes is joined by the next one:
    paragraphs up to a surviving end share an island. Segments keep their order inside.
    """
    gone = removed(F.col("mark"), accept)
    before = Window.partitionBy("doc_id").orderBy("para").rowsBetween(Window.unboundedPreceding, -1)
    island = marks.withColumn("island", F.coalesce(F.sum(F.when(gone, 0).otherwise(1)).over(before), F.lit(0)))
    kept = segments.where(~removed(F.col("kind"), accept)).select("doc_id", "para", "seg", "text")
    rows = island.join(kept, ["doc_id", "para"], "left")
    parts = F.array_sort(F.collect_list(F.struct("para", "seg", "text")))
    out = rows.groupBy("doc_id", "island").agg(F.min("para").alias("para"), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "").alias("text"))
    return out.select("doc_id", "para", "text")


def resolve_rows(rows: DataFrame, by: list[str], accept: bool = True) -> DataFrame:
    """Table rows (row_no, rev) that stay; tables without any are gone. rev is cleared."""
    return rows.where(~removed(F.col("rev"), accept)).withColumn("rev", F.lit(None).cast("string"))


def resolved_count(segments: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, n: how many changes there are to resolve."""
    return segments.where("kind is not null").select("doc_id").unionAll(marks.where("mark is not null").select("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def has_revisions(segments: DataFrame, marks: DataFrame) -> DataFrame:
    a = segments.groupBy("doc_id").agg(F.bool_or(F.col("kind").isNotNull()).alias("a"))
    b = marks.groupBy("doc_id").agg(F.bool_or(F.col("mark").isNotNull()).alias("b"))
    return b.join(a, "doc_id", "left").select("doc_id", (F.col("b") | F.coalesce("a", F.lit(False))).alias("has_revisions"))


def visible(kind: Column, view: str) -> Column:
    """Whether a segment shows in a view: accepted, original or marked."""
    if view == "marked":
        return F.lit(True)
    return ~removed(kind, view == "accepted")


def record(text: str, start: int, count: int, new: str) -> list[tuple[str | None, str]]:
    """Segments of one recorded edit: what is removed stays, marked; what is new follows it."""
    start = max(0, min(start, len(text)))
    end = max(start, min(start + count, len(text)))
    parts = [(None, text[:start]), ("del", text[start:end]), ("ins", new), (None, text[end:])]
    return [p for p in parts if p[1]]
