"""From raw documents to packed training sequences: language ID, exact dedup, near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. Null texts have no letters and go in the first stage; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import exact, langid, near, packing, secret_scan
from pagemill.llm.common import scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language: null, or without letters. Clean texts that mix languages have low scores, and stay."""
    model = langid.train(docs)
    found = langid.identify(docs, model, pred_col="__lang", score_col="__score")
    # With nothing to learn from, every answer is unknown, and letters alone count.
    keep = F.col("__lang") != langid.UNKNOWN if model.languages else F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return found.where(keep).select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the smallest id stays. Rows without an id stay unless all of them copy others."""
    classes = near.near_duplicates(docs)
    kept = classes.where(F.col("class_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("__kept"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("__kept")), "left_semi")


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts and counts their code points anew; no document goes."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan_stage),
    ("packing", pack_sequences),
]
#: SQL can't express language ID, near-duplicates or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
