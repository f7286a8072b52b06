"""Budgets and diagnostics as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Inclusive default ceilings.
DEFAULTS = {
    "input_bytes": 128 << 20,
    "parts": 16_384,
    "inflated_bytes": 1 << 30,
    "part_bytes": 512 << 20,
    "xml_characters": 512 << 20,
    "xml_nodes": 4_000_000,
    "xml_depth": 256,
    "text_characters": 16_000_000,
    "markup_nodes": 2_000_000,
    "markup_depth": 256,
    "lines": 1_000_000,
    "media_bytes": 64 << 20,
    "total_media_bytes": 256 << 20,
    "embedded_bytes": 128 << 20,
    "embedded_objects": 4096,
}


class BudgetExceeded(ValueError):
    def __init__(self, name: str, limit: int, observed: int):
        super().__init__(f"{name}: {observed} is over {limit}")
        self.name, self.limit, self.observed = name, limit, observed


def validated(limits: dict[str, int] | None = None) -> dict[str, int]:
    out = DEFAULTS | (limits or {})
    for name, value in out.items():
        if name not in DEFAULTS:
            raise ValueError(f"no such limit: {name}")
        if value <= 0:
            raise ValueError(f"{name} must be positive")
    return out


def ensure(name: str, observed: int, limits: dict[str, int]) -> None:
    if observed > limits[name]:
        raise BudgetExceeded(name, limits[name], observed)


def rejects(rows: DataFrame, observed: dict[str, Column], limits: dict[str, int] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, limit_name, limit, observed) for each ceiling that a row breaks."""
    chosen = validated(limits)
    checks = F.array(*[F.struct(F.lit(k).alias("limit_name"), F.lit(chosen[k]).cast("long").alias("limit"), c.cast("long").alias("observed")) for k, c in observed.items()])
    return rows.select(id_col, F.explode(F.filter(checks, lambda x: x["observed"] > x["limit"])).alias("x")).select(id_col, "x.*")


def text_rejects(docs: DataFrame, limits: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return rejects(docs, {"text_characters": F.length(text_col), "lines": F.regexp_count(text_col, F.lit("\n")) + 1}, limits, id_col)


def media_rejects(media: DataFrame, limits: dict[str, int] | None = None, id_col: str = "doc_id") -> DataFrame:
    """media: (doc_id, ord, size). Breaks of a single item's ceiling and of the running total's, the latter where it first happens."""
    chosen = validated(limits)
    run = media.withColumn("total", F.sum("size").over(Window.partitionBy(id_col).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    single = rejects(run, {"media_bytes": F.col("size")}, limits, id_col)
    first = run.where(F.col("total") > chosen["total_media_bytes"]).groupBy(id_col).agg(F.min("total").alias("observed"))
    return single.unionByName(first.select(id_col, F.lit("total_media_bytes").alias("limit_name"), F.lit(chosen["total_media_bytes"]).cast("long").alias("limit"), F.col("observed").cast("long")))


def distinct_diagnostics(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """The first of each (kind, subject) in a document, by ord."""
    n = F.row_number().over(Window.partitionBy(by, "kind", "subject").orderBy("ord"))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def first_wins(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")
