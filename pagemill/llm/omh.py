"""Operator 10: order-min-hash fingerprints of documents, sensitive to edit distance.

A text's k-mers of code points are numbered by occurrence, so repeated ones differ. Their hashes fall into ``SKETCHES`` bins (one
permutation, cut up); of each bin the ``TUPLE`` smallest are selected, put back into text order and hashed as a tuple. A bin with
fewer takes what it has; an empty bin copies one that has some, found by a fixed sequence of draws. The likeness of two
fingerprints is the share of equal positions: it drops both when k-mers differ and when they change places.

Defined results: a null text counts as empty; a text shorter than k has one k-mer, itself; empty texts share a fingerprint of
their own; equal texts have equal fingerprints. The next document is that with the next id (a null id is the first), rows with the same id in order of
text, after the last the first; a single document is its own next. An empty table gives no rows. Only the id and text
columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_map, batch, mix, stored

K, SKETCHES, TUPLE = 12, 64, 2
#: For an empty bin, where to look, in order.
DRAWS = np.random.default_rng(20).integers(0, SKETCHES, (SKETCHES, 4096), dtype=np.int64)
#: One odd multiplier for each place in a k-mer.
WEIGHTS = mix(np.arange(1, K + 1, dtype=np.uint64)) | np.uint64(1)


def kmer_hashes(points: np.ndarray) -> np.ndarray:
    """Hashes of all k-mers, by doubling: those of 4, then 8, then 12 code points."""
    p = points.astype(np.uint64)
    if len(p) < K:
        return mix(np.array([(p * WEIGHTS[: len(p)]).sum(dtype=np.uint64) + np.uint64(len(p))], np.uint64)) if len(p) else np.empty(0, np.uint64)
    four = p[:-3] * WEIGHTS[0] + p[1:-2] * WEIGHTS[1] + p[2:-1] * WEIGHTS[2] + p[3:] * WEIGHTS[3]
    out = four[: len(p) - K + 1].copy()
    out ^= out >> np.uint64(29)
    out *= WEIGHTS[4]
    out += four[4 : len(p) - K + 5]
    out ^= out >> np.uint64(31)
    out *= WEIGHTS[5]
    out += four[8 : len(p) - K + 9]
    return mix(out)


def fingerprint(text: str) -> np.ndarray:
    """SKETCHES 32-bit integers."""
    hashes = kmer_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    n = len(hashes)
    if not n:
        return np.zeros(SKETCHES, np.uint32)
    # Sorted by hash (its low bits give way to the place), equal k-mers stand together in text order.
    bits = np.uint64(max(1, (n - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    order = np.sort((hashes & ~low) | np.arange(n, dtype=np.uint64))
    place, kmer = (order & low).astype(np.int64), order >> bits
    fresh = np.ones(n, bool)
    fresh[1:] = kmer[1:] != kmer[:-1]
    again = np.flatnonzero(~fresh)
    value = hashes[place]
    if len(again):
        first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        value[again] = mix(value[again] + (again - first[again]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bins = (value >> np.uint64(58)).astype(np.int64)
    # Few of the values can be among a bin's smallest: look at those below a bound first, at all if a bin comes out short.
    rest = value & np.uint64((1 << 58) - 1)
    bound = (1 << 58) * 12 * SKETCHES // n
    chosen = np.flatnonzero(rest < np.uint64(bound)) if bound < 1 << 58 else np.arange(n)
    if len(chosen) < n and (np.bincount(bins[chosen], minlength=SKETCHES) < TUPLE).any():
        chosen = np.arange(n)
    chosen = chosen[np.argsort(value[chosen], kind="stable")]
    groups = bins[chosen]
    starts = np.searchsorted(groups, np.arange(SKETCHES))
    size = np.searchsorted(groups, np.arange(SKETCHES), "right") - starts
    out = np.zeros(SKETCHES, np.uint64)
    full = np.flatnonzero(size)
    a = chosen[starts[full]]
    b = chosen[np.minimum(starts[full] + 1, len(chosen) - 1)]
    two = size[full] > 1
    swap = two & (place[b] < place[a])
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    out[full] = mix(value[a] + np.where(two, mix(value[b] ^ np.uint64(0x5851F42D4C957F2D)), np.uint64(1)))
    if len(full) < SKETCHES:
        empty = np.flatnonzero(size == 0)
        usable = (size > 0)[DRAWS[empty]]
        source = DRAWS[empty, np.argmax(usable, 1)]
        source = np.where(usable.any(1), source, full[0])
        out[empty] = out[source]
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def packed(prints: np.ndarray) -> bytes:
    return prints.astype(">u4").tobytes()


def edited(text: str, after: str) -> str:
    """text with its last half replaced by as much, or all, of the start of after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


#: Digests and fingerprints are bytes until the end, then hex digits.
ROWS = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def compared(rows: Iterator[tuple]) -> list:
    """Columns of ROWS for tuples (doc_id, text, its fingerprint, next text, its fingerprint)."""
    out: list[list] = [[] for _ in SCHEMA]
    for doc, text, own, after, other in rows:
        new = edited(text, after)
        changed = fingerprint(new)
        for column, x in zip(out, (doc, len(text), hashlib.sha256(new.encode("utf-8", "replace")).digest(), packed(own), packed(changed), likeness(own, changed), likeness(own, other)), strict=True):
            column.append(x)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row; no shuffle."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])
        for b in batches:
            yield batch(schema, b.column(0), [packed(fingerprint(t or "")).hex() for t in b.column(1).to_pylist()])

    return arrow_map(docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")), run, "doc_id long, fingerprint string")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs, each held against its edited text and against the next document.

    Documents are range-partitioned by id once. A task can't see the next task's first document, so each leaves its first and
    last one; a second, small step pairs those, two rows for each partition.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        schema = pa.schema([*SCHEMA, ("part", pa.int32()), ("first", pa.bool_()), ("text", pa.string())])
        held = None

        def pairs(names, texts):
            nonlocal held
            for name, text in zip(names, texts, strict=True):
                text = text or ""
                prints = fingerprint(text)
                if held:
                    yield *held, text, prints
                held = name, text, prints

        def end(first):
            return batch(schema, [held[0]], *[pa.nulls(1, f.type) for f in list(SCHEMA)[1:]], [part], [first], [held[1]])

        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(0, len(names), 512):
                a, z = names[i : i + 512], texts[i : i + 512]
                if held is None:
                    list(pairs(a[:1], z[:1]))
                    yield end(True)
                    a, z = a[1:], z[1:]
                columns = compared(pairs(a, z))
                k = len(columns[0])
                yield batch(schema, *columns, *[pa.nulls(k, t) for t in (pa.int32(), pa.bool_(), pa.string())])
        if held:
            yield end(False)

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Texts' beginnings tell apart rows without an id or with the same one, which would else all go to one task.
    begin = F.substring("text", 1, 64).asc_nulls_first()
    ordered = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), begin).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    found = stored(arrow_map(ordered, run, f"{ROWS}, part int, first boolean, text string"), "omh")
    ends = found.where("part is not null")
    parts = sorted(r[0] for r in ends.where("first").select("part").collect())  # a number for each partition
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    last = ends.where("not first").select("part", "doc_id", "text").join(F.broadcast(after), "part")
    met = last.join(ends.where("first").select(F.col("part").alias("next"), F.col("text").alias("after")), "next").select("doc_id", "text", "after")

    def meet(batches):
        for b in batches:
            rows = ((d, t, fingerprint(t), a, fingerprint(a)) for d, t, a in zip(*(c.to_pylist() for c in b.columns), strict=True))
            yield batch(SCHEMA, *compared(rows))

    rows = found.where("part is null").select(SCHEMA.names).unionByName(arrow_map(met, meet, ROWS))
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def op10_order_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
