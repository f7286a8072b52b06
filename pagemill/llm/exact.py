"""Operator 8: exact deduplication that splits off heavy hitters.

Texts are equal when their normalised bytes (without U+0020 and U+0009 to U+000D) have the same SHA-256. Each task summarises the
digests it sees with Misra-Gries counters; a digest with more than a share ``hot`` of all rows is surely among the candidates,
and a second count over the candidates verifies them. There are at most 1/hot winners, whatever the input, so they are broadcast
and their rows are settled map-side. All other digests, none of them with more than that share, are counted by partial aggregates
of (digest, id, length) rows, and a join tells their rows. Of equal texts the row with the most code points stays, then that with the smallest id.

Defined results: a null text counts as empty, and empty texts are equal; a null id sorts last; rows that repeat id and text share
one verdict in ``resolve`` (``deduplicate`` keeps one of them, and one of each text without an id); an empty table gives no rows; other columns are never read by
``resolve``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_map, as_bytes, batch, stored

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Share of all rows from which a digest is hot, and counters of a task's summary: more than 1 / HOT, or it would miss some.
HOT, COUNTERS = 1 / 256, 1024
#: The row that stays, of digests' rows.
BEST_ORDER = "struct(-n_points AS less, doc_id IS NULL AS last, doc_id)"


def normalised(text: bytes) -> bytes:
    return text.translate(None, SPACES)


def addressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest, n_points (code points of the original text)."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_points", pa.int64())])
        for b in batches:
            yield batch(schema, b.column(0), [hashlib.sha256(normalised(t)).digest() for t in as_bytes(b.column(1))], pc.fill_null(pc.utf8_length(b.column(1)), 0).cast(pa.int64()))

    return arrow_map(docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")), run, "doc_id long, digest binary, n_points long")


class MisraGries:
    """At most k counters; a key's count is too low by at most n / (k + 1)."""

    def __init__(self, k: int):
        self.k, self.counts, self.n = k, {}, 0

    def add(self, keys: list[bytes]) -> None:
        counts, k = self.counts, self.k
        self.n += len(keys)
        for x in keys:
            if x in counts:
                counts[x] += 1
            elif len(counts) < k:
                counts[x] = 1
            else:  # one off every counter
                counts = {y: c - 1 for y, c in counts.items() if c > 1}
        self.counts = counts


def heavy(rows: DataFrame, hot: float, counters: int) -> DataFrame:
    """The digests with at least a share hot of rows: digest, group_size, keep_id, keep_points; verified counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = MisraGries(counters)
        for b in batches:
            seen.add(b.column(0).to_pylist())
        yield batch(pa.schema([("digest", pa.binary()), ("least", pa.int64()), ("n", pa.int64())]), [None, *seen.counts], [0, *seen.counts.values()], [seen.n, *[0] * len(seen.counts)])

    found = stored(arrow_map(rows.select("digest"), run, "digest binary, least long, n long"), "misra-gries")
    total = found.agg(F.sum("n")).first()[0] or 0
    least = total * hot
    # The summed counts are too low by at most total / (counters + 1): no hot digest is missed, and at most 1 / (hot - 1 / (counters + 1)) pass.
    candidates = found.where("digest is not null").groupBy("digest").agg(F.sum("least").alias("least")).where(F.col("least") >= least - total / (counters + 1)).select("digest")
    counted = rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.expr(BEST_ORDER)).alias("best"))
    return counted.where(F.col("group_size") >= max(2, least)).select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("keep_points"))


def verdicts(docs: DataFrame, id_col: str, text_col: str, hot: float, counters: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest, n_points of every row."""
    if not counters + 1 > 1 / hot:
        raise ValueError("counters + 1 must be over 1 / hot")
    rows = stored(addressed(docs, id_col, text_col), "digests")
    winners = stored(heavy(rows, hot, counters), "heavy")
    split = rows.join(F.broadcast(winners), "digest", "left")
    columns = ["doc_id", "keep_id", "keep_points", "group_size", "n_points", "digest"]
    settled = split.where("group_size is not null").select(columns)
    rest = split.where("group_size is null").select("digest", "doc_id", "n_points")
    # Copies meet as partial counts and minima, and the rows then meet one row for each digest: no group is one task's work.
    best = rest.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.expr(BEST_ORDER)).alias("best")).select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("keep_points"))
    rest = rest.join(best, "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    return settled.unionByName(rest.select(columns)).select("doc_id", "keep_id", F.col("group_size").cast("long"), kept.alias("kept"), "digest", "n_points")


def resolve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: float = HOT, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    return verdicts(docs, id_col, text_col, hot, counters).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns: of every text one, whether or not its row has an id or shares it with other texts."""
    # A row is known by its id (0 and a mark for none), its digest and its length.
    known = ["__id", "__none", "__digest", "__points"]
    verdict = verdicts(docs, id_col, text_col, HOT, COUNTERS).where("kept")
    names = [F.coalesce("doc_id", F.lit(0)).alias("__id"), F.isnull("doc_id").alias("__none"), F.col("digest").alias("__digest"), F.col("n_points").alias("__points")]
    verdict = verdict.select(names).groupBy(known).agg(F.count(F.lit(1)).alias("__rows"))
    id_, text = docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.translate(text, SPACES.decode(), "").cast("binary"), 256))
    rows = docs.withColumns({"__id": F.coalesce(id_, F.lit(0)), "__none": F.isnull(id_), "__digest": digest, "__points": F.length(text).cast("long")}).join(verdict, known)
    # Where several rows are known by the same, which takes repeated ids or rows without one, they meet as partial minima.
    again = rows.where("__rows > 1").groupBy(known).agg(F.min_by(F.struct(docs.columns), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("__row"))
    return rows.where("__rows = 1").select(docs.columns).unionByName(again.select("__row.*"))


def op8_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
