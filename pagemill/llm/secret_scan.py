"""Operator 7: secret scans with an incremental blob ledger, in DataFrame functions alone.

Every historical version of every path is addressed by the SHA-256 of its text. The ledger is a table of (blob, rules) pairs that
have been scanned, partitioned by ``rules``, the version of the rules; findings are a table beside it. A run scans the pairs that
the ledger doesn't have, each blob once however many paths hold it, appends to both tables and joins the findings back to all
paths. Which copy of a blob is scanned is settled on (blob, id) pairs without texts, so a blob that a third of all rows share is
one row before any text moves; rows that repeat both path and text are scanned each, and count once. An interrupted run leaves
blobs unlisted, which the next run scans again; findings of blobs that are not
listed are ignored, so nothing counts twice.

A kind is a pattern, searched leftmost and without overlaps; a match that fails the kind's length rule is dropped but still
consumes its text. Places are code points. They come from the lengths of the gaps between matches: with ``\\G`` each search goes on
where the last match ended. Texts without a match of a kind are read once for it, others once more for each part of its matches.

Defined results: a null text counts as empty; a row without findings has empty spans; repeated rows are returned each; an empty
table gives no rows; columns beside the id and the text are never read. A null id joins nothing but its own text's findings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import scratch


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Group whose code points are counted (0: the match), and the least count.
    group: int
    least: int


#: The base kinds, in the order that ends ties, and those that this method adds. A change of these is a new RULES version.
BASE = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # Runs are maximal, so a run's least length can stand in its pattern; that of assign can't, as a match that fails consumes its text.
    Kind("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Kind("hex", r"[0-9a-f]{32,}", 0, 32),
)
ADDED = (
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Kind("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)
RULES = "base-1+pem-github-1"
FINDINGS = "blob binary, n_assign long, n_access long, n_hex long, base string, spans string, rules string"


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """Array of (start, rank, kind, end) of the matches that pass; places from running sums of gap and match lengths."""
    whole = rf"(?s)\G(.*?)({kind.pattern})"
    gaps, found = F.regexp_extract_all(text, F.lit(whole), F.lit(1)), F.regexp_extract_all(text, F.lit(whole), F.lit(2))
    counted = F.regexp_extract_all(text, F.lit(whole), F.lit(2 + kind.group)) if kind.group else found
    item = F.struct(F.lit(0).cast("long").alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), F.lit(0).cast("long").alias("end"))
    empty = F.filter(F.array(item), lambda x: F.lit(False))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        one = F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), end.cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when(F.length(x["counted"]) >= kind.least, F.concat(state["spans"], F.array(one))).otherwise(state["spans"]).alias("spans"))

    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("found"), counted.alias("counted"))
    zipped = F.transform(zipped, lambda x: F.struct(x["gap"].alias("gap"), x["found"].alias("found"), x["counted"].alias("counted")))
    return F.when(text.rlike(kind.pattern), F.aggregate(zipped, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), step, lambda s: s["spans"])).otherwise(empty)


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def scan(blobs: DataFrame, rules: str = RULES, added: tuple[Kind, ...] = ADDED) -> DataFrame:
    """FINDINGS of rows (blob, text)."""
    kinds = [*BASE, *added]
    found = blobs.select("blob", *[spans_of(F.col("text"), k, i).alias(f"spans_{k.name}") for i, k in enumerate(kinds)])
    base = F.concat(*[F.col(f"spans_{k.name}") for k in BASE])
    whole = F.concat(*[F.col(f"spans_{k.name}") for k in kinds])
    return found.select("blob", *[F.size(f"spans_{k.name}").cast("long").alias(f"n_{k.name}") for k in BASE], joined(base).alias("base"), joined(whole).alias("spans"), F.lit(rules).alias("rules"))


class BlobLedger:
    """Tables ``scanned`` (blob, rules) and ``findings`` under one path, which only grow."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/scanned")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def scanned(self) -> DataFrame:
        return self.spark.read.schema("blob binary, rules string").parquet(f"{self.path}/scanned")

    def findings(self, rules: str = RULES) -> DataFrame:
        """One row for each scanned blob that has any finding."""
        rows = self.spark.read.schema(FINDINGS).parquet(f"{self.path}/findings").where(F.col("rules") == rules)
        return rows.dropDuplicates(["blob"])

    def update(self, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: str = RULES, added: tuple[Kind, ...] = ADDED) -> None:
        """Scans what the ledger doesn't have for rules among versions, a row for each path and version."""
        text = F.coalesce(versions[text_col].cast("string"), F.lit(""))
        addressed = versions.select(versions[id_col].cast("string").alias("path"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"), text.alias("text"))
        # One path for each unseen blob, then that path's text: only (blob, path) pairs are grouped, with partial minima.
        unseen = addressed.groupBy("blob").agg(F.min(F.coalesce("path", F.lit(""))).alias("path"))
        if self.exists():
            unseen = unseen.join(self.scanned().where(F.col("rules") == rules), "blob", "left_anti")
        texts = addressed.withColumn("path", F.coalesce("path", F.lit(""))).join(unseen, ["blob", "path"], "left_semi")
        found = scan(texts, rules, added).where("spans != ''")
        found.write.mode("append").parquet(f"{self.path}/findings")
        unseen.select("blob", F.lit(rules).alias("rules")).write.mode("append").parquet(f"{self.path}/scanned")

    def report(self, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: str = RULES) -> DataFrame:
        """For every row of versions its id, blob and findings; empty where there are none."""
        text = F.coalesce(versions[text_col].cast("string"), F.lit(""))
        paths = versions.select(versions[id_col].alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"))
        rows = paths.join(self.findings(rules).drop("rules"), "blob", "left")
        return rows.select("doc_id", "blob", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_assign", "n_access", "n_hex")], F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"))


def scan_documents(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Updates the ledger at that path (a new one unless given) and reports on docs."""
    spark = docs.sparkSession
    book = BlobLedger(spark, ledger or scratch(spark, "ledger"))
    book.update(docs, id_col, text_col)
    return book.report(docs, id_col, text_col)


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with every stretch that spans (the report's string) cover replaced by mark; overlapping ones by one."""
    item = F.transform(F.split(spans, ","), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("start"), F.split(x, ":")[2].cast("int").alias("end")))

    def step(state: Column, x: Column) -> Column:
        fresh = x["start"] >= state["at"]
        out = F.when(fresh, F.concat(state["out"], F.substring(text, state["at"] + 1, x["start"] - state["at"]), F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(F.array_sort(item), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.coalesce(spans, F.lit("")) == "", text).otherwise(done)


def redact(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the secrets in their texts replaced; all columns stay. Findings are joined by blob, so copies are treated alike."""
    spark = docs.sparkSession
    book = BlobLedger(spark, ledger or scratch(spark, "ledger"))
    book.update(docs, id_col, text_col)
    found = book.findings().select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    joined = docs.withColumn("__blob", F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))).join(found, "__blob", "left")
    return joined.withColumn(text_col, redacted(F.col(text_col), F.col("__spans"))).select(docs.columns)


def op7_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def _sql_spans(kind: Kind, rank: int) -> str:
    """DuckDB: list of (start, rank, kind, end), as in spans_of; RE2 searches on from the last match by itself."""
    pattern = kind.pattern.replace("'", "''")
    whole = rf"(?s)(.*?)({pattern})"
    part = lambda g: f"regexp_extract_all(text, '{whole}', {g})"
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind.name}' AS kind, unnest(ends) - unnest(lens) AS s, unnest(ends) AS e, unnest(counted) AS counted FROM (
    SELECT doc_id, lens, counted, list_transform(range(1, len(lens) + 1), lambda i: list_sum(gaps[1:i]) + list_sum(lens[1:i])) AS ends FROM (
      SELECT doc_id, list_transform({part(1)}, lambda x: length(x)) AS gaps, list_transform({part(2)}, lambda x: length(x)) AS lens, list_transform({part(2 + kind.group)}, lambda x: length(x)) AS counted
      FROM d WHERE regexp_matches(text, '{pattern}')))"""


OP7_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ("
    + " UNION ALL ".join(f"SELECT * FROM ({_sql_spans(k, i)}) WHERE counted >= {k.least}" for i, k in enumerate((*BASE, *ADDED)))
    + """), g AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""
)
