"""Operator 2: near-duplicate classes by consistent weighted sampling over TF-IDF shingles.

A text's features are its distinct shingles of five words (fewer words: one shingle of them all), weighted by tf * idf. Document
frequencies count all documents, in a table of ``2**DF_BITS`` buckets of hashed shingles, so the broadcast table has a fixed size.
What rare shingles add to every bucket, the table's median, is taken off: however many there are, frequent ones stand out.
Improved consistent weighted sampling (Ioffe) runs in bins: a shingle's hash gives its bin and the draws r, c and beta, and a bin's
sample is the pair (shingle, t) of least a = c / (y e^r). Empty bins copy others by a fixed sequence of draws. ``BANDS`` bands of
``ROWS`` samples give candidates, which are verified by the weighted Jaccard similarity of their whole texts.

Equal texts are one node from the start. In a band's bucket nodes aren't all paired at first: small buckets are, and the nodes of
larger ones are compared with ``LEADERS`` of them, by hashes of the ids, so that the buckets of a group share their leaders. That
only saves work: then every pair of nodes of a bucket that are still in two classes is compared, block by block. Links make classes
by alternating large-star and small-star steps. Buckets, links and labels stay distributed; verification splits a leader's partners
over tasks and streams them past the leader's features.

Defined results: a null text counts as empty; texts without words are alike only if equal; the class id is the smallest id of its
documents; rows that share an id share a class, even if their texts differ; a row without an id has the class of an equal text
with one, else null; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_map, as_bytes, batch, chunks, mix, stored, word_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
SAMPLES = BANDS * ROWS
DF_BITS, DF_CHUNKS = 20, 64
#: The rarest shingle weighs so much more than one of every document. A wider range would tear large groups of near copies apart,
#: as what they share is frequent for that very reason, and what sets each apart is rare.
SPREAD = 0.2
HASH_BITS = 52
#: Buckets up to this size are paired in full at once, larger ones have so many leaders; a leader's partners come in groups of PARTNERS.
SMALL, LEADERS, PARTNERS = 6, 4, 512
#: Nodes of a block, when a bucket's classes are compared with each other.
BLOCK = 128
DRAWS = np.random.default_rng(52).integers(0, SAMPLES, (SAMPLES, 2048), dtype=np.int64)
_PLACES = mix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)
_U = np.uint64


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes (below 2**52) of at most 4096 texts, in order of text and hash; their counts; the start of each text's, with the end."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    n = max(0, len(words) - WORDS + 1)
    doc = np.repeat(np.arange(len(texts)), counts)
    shingles = np.zeros(n, _U)
    for k in range(WORDS):
        shingles += words[k : n + k] * _PLACES[k]
    inside = np.arange(n) + WORDS <= ends[doc[:n]]
    hashes, owner = mix(shingles[inside]), doc[:n][inside]
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        few = [mix((words[ends[d] - counts[d] : ends[d]] * _PLACES[: counts[d]]).sum(dtype=_U, keepdims=True) + _U(counts[d]))[0] for d in short]
        hashes, owner = np.concatenate((hashes, np.array(few, _U))), np.concatenate((owner, short))
    key = np.sort((owner.astype(_U) << _U(HASH_BITS)) | (hashes >> _U(64 - HASH_BITS)))
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    key, tf = key[at], np.diff(at, append=len(key))
    starts = np.searchsorted(key, np.arange(len(texts) + 1, dtype=_U) << _U(HASH_BITS))
    return key & _U((1 << HASH_BITS) - 1), tf, starts


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & _U((1 << DF_BITS) - 1)).astype(np.int64)


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Samples of each text, a row of SAMPLES; texts without features get zeros."""
    docs = len(starts) - 1
    out, full = np.zeros(docs * SAMPLES, _U), np.zeros(docs * SAMPLES, bool)
    if len(hashes):
        draws = [uniform(mix(hashes ^ _U(0x9E3779B97F4A7C15 * k & (1 << 64) - 1))) for k in range(1, 6)]
        r, c, beta = -np.log(draws[0] * draws[1]), -np.log(draws[2] * draws[3]), draws[4]
        t = np.floor(np.log(weights) / r + beta)
        ln_a = np.log(c) - r * (t - beta) - r
        cell = np.repeat(np.arange(docs), np.diff(starts)) * SAMPLES + ((hashes * _U(SAMPLES)) >> _U(HASH_BITS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        least = np.minimum.reduceat(ln_a, first)
        best = np.flatnonzero(ln_a == np.repeat(least, np.diff(first, append=len(cell))))
        out[cell[best]] = mix(hashes[best] ^ mix(t[best].astype(np.int64).view(_U)))
        full[cell[first]] = True
    out, full = out.reshape(docs, SAMPLES), full.reshape(docs, SAMPLES)
    some = np.flatnonzero(full.any(1))
    row, col = np.nonzero(~full[some])
    row = some[row]
    for k in range(DRAWS.shape[1]):
        if not len(row):
            break
        source = DRAWS[col, k]
        found = full[row, source]
        out[row[found], col[found]] = out[row[found], source[found]]
        row, col = row[~found], col[~found]
    if len(row):  # no draw met a filled bin: the first filled one
        out[row, col] = out[row, np.argmax(full[row], 1)]
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A key for each band of each text."""
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=_U)), (len(samples), BANDS)).copy()
    for k in range(ROWS):
        keys = mix(keys * _U(0x9E3779B97F4A7C15) + samples[:, k::ROWS])
    return keys.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least over sum of greatest weights of (sorted hashes, weights)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    common = np.minimum(a[1][both], b[1][at[both]]).sum() if both.any() else 0.0
    total = a[1].sum() + b[1].sum() - common
    return float(common / total) if total > 0 else 0.0


def small_chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Chunks of at most 4096 texts."""
    for a, b in chunks(sizes, 1 << 20):
        for s in range(a, b, 4096):
            yield s, min(s + 4096, b)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """1 + SPREAD * ln(1 + documents / document frequency) / ln(1 + documents) of each bucket, over all rows of docs (text).

    A bucket's count is its frequent shingle's, if it has one, and that of the rare ones that share the bucket. The latter is much the
    same in all buckets, and the median of all buckets stands for it.
    """
    each = (1 << DF_BITS) // DF_CHUNKS

    def count(batches):
        schema = pa.schema([("chunk", pa.int32()), ("rows", pa.int64()), ("counts", pa.binary())])
        total, rows, waiting, held = np.zeros(1 << DF_BITS, np.int32), 0, [], 0
        for b in batches:
            texts = as_bytes(b.column(0))
            rows += len(texts)
            for s, e in small_chunks([len(t) for t in texts]):
                waiting.append(bucket(features(texts[s:e])[0]))
                held += len(waiting[-1])
                if held > 1 << DF_BITS:
                    total += np.bincount(np.concatenate(waiting), minlength=1 << DF_BITS).astype(np.int32)
                    waiting, held = [], 0
        if rows:
            if waiting:
                total += np.bincount(np.concatenate(waiting), minlength=1 << DF_BITS).astype(np.int32)
            yield batch(schema, range(DF_CHUNKS), [rows, *[0] * (DF_CHUNKS - 1)], [total[k * each : (k + 1) * each].tobytes() for k in range(DF_CHUNKS)])

    def add(batches):
        schema = pa.schema([("chunk", pa.int32()), ("rows", pa.int64()), ("counts", pa.binary())])
        sums, rows = {}, {}
        for b in batches:
            for k, n, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sums.setdefault(k, np.zeros(each, np.int64)).__iadd__(np.frombuffer(counts, np.int32))
                rows[k] = rows.get(k, 0) + n
        if sums:
            yield batch(schema, list(sums), list(rows.values()), [x.tobytes() for x in sums.values()])

    kind = "chunk int, rows long, counts binary"
    table, n = np.zeros((DF_CHUNKS, each), np.int64), 0
    for k, rows, counts in arrow_map(arrow_map(docs.select("text"), count, kind).repartition("chunk"), add, kind).collect():  # 2**DF_BITS counts, whatever the input
        table[k] = np.frombuffer(counts, np.int64)
        n += rows
    counts = np.clip(table.reshape(-1) - int(np.median(table)), 1, max(n, 1))
    return (1 + SPREAD * np.log1p(n / counts) / np.log1p(max(n, 1))).astype(np.float32)


def node_bands(docs: DataFrame, idf) -> DataFrame:
    """doc_id, digest of the text, bands of rows (doc_id, text); bands are empty without words."""

    def run(batches):
        kind = pa.list_(pa.field("element", pa.int64()))
        schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("bands", kind)])
        for b in batches:
            texts = as_bytes(b.column(1))
            digests = [hashlib.sha256(t).digest() for t in texts]
            # Of equal texts in a batch the first is worked on.
            place: dict[bytes, int] = {}
            mine = [place.setdefault(d, len(place)) for d in digests]
            own: list[bytes] = [b""] * len(place)
            for k, t in zip(mine, texts, strict=True):
                own[k] = t
            keys, words = [], []
            for s, e in small_chunks([len(t) for t in own]):
                hashes, tf, starts = features(own[s:e])
                keys.append(band_keys(signatures(hashes, tf * idf.value[bucket(hashes)], starts)))
                words.append(np.diff(starts) > 0)
            if not keys:
                continue
            keys, words = np.concatenate(keys)[mine], np.concatenate(words)[mine]
            lens = np.where(words, BANDS, 0)
            yield batch(schema, b.column(0), digests, pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(lens))).astype(np.int32), pa.array(keys[words].reshape(-1)), type=kind))

    return arrow_map(docs, run, "doc_id long, digest binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """The pairs (a, b) of node ids whose texts are alike. A leader a with many partners is dealt to several tasks."""
    load = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    dealt = pairs.join(load, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.expr(f"1 + n div {PARTNERS}")).cast("int").alias("share"))
    partners = dealt.join(texts.select(F.col("id").alias("b"), "text"), "b").select("a", "share", "b", "text")
    leaders = load.select("a", F.explode(F.expr(f"sequence(0, cast(n div {PARTNERS} as int))")).alias("share")).join(texts.select(F.col("id").alias("a"), "text"), "a").select("a", "share", F.lit(None).cast("long").alias("b"), "text")

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        at, leader, weight = None, None, 0.0
        for x in batches:
            ids, shares, others, texts = x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2).to_pylist(), as_bytes(x.column(3))
            found = []
            for s, e in small_chunks([len(t) for t in texts]):
                hashes, tf, starts = features(texts[s:e])
                w = tf * idf.value[bucket(hashes)].astype(np.float64)
                for i in range(s, e):
                    own = slice(starts[i - s], starts[i - s + 1])
                    if others[i] is None:
                        at, leader = (ids[i], shares[i]), (hashes[own].copy(), w[own].copy())
                        weight = leader[1].sum()
                    elif at == (ids[i], shares[i]) and min(weight, w[own].sum()) >= (similarity - 1e-9) * max(weight, w[own].sum()) and weighted_jaccard(leader, (hashes[own], w[own])) >= similarity:
                        found.append((ids[i], others[i]))
            if found:
                yield batch(schema, *zip(*found, strict=True))

    rows = leaders.unionByName(partners).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    return arrow_map(rows, run, "a long, b long").distinct()


def between(nodes: list[tuple[int, int, bool, np.ndarray, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """Alike nodes (id, class, left, hashes, weights) of two classes: left ones with the others, or with each other if all are left."""
    nodes = [x for x in nodes if len(x[3])]
    one = all(x[2] for x in nodes)
    left = nodes if one else [x for x in nodes if x[2]]
    right = nodes if one else [x for x in nodes if not x[2]]
    if not left or not right or len({x[1] for x in nodes}) < 2:
        return []
    lens = np.array([len(x[3]) for x in right])
    names, index = np.unique(np.concatenate([x[3] for x in right]), return_inverse=True)
    weights, starts = np.concatenate([x[4] for x in right]), np.cumsum(lens) - lens
    classes, totals = np.array([x[1] for x in right]), np.add.reduceat(weights, starts)
    own, found = np.zeros(len(names)), []
    for k, (id_, class_, _, hashes, w) in enumerate(left):
        at = np.searchsorted(names, hashes)
        at[at == len(names)] = 0
        both = names[at] == hashes
        own[at[both]] = w[both]
        common = np.add.reduceat(np.minimum(own[index], weights), starts)
        own[at] = 0
        near = (common >= (similarity - 1e-9) * (w.sum() + totals - common)) & (classes != class_)
        near[: k + 1 if one else 0] = False
        found += [(id_, right[j][0]) for j in np.flatnonzero(near) if weighted_jaccard((hashes, w), right[j][3:]) >= similarity]
    return found


def across(buckets: DataFrame, labels: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """The pairs (a, b) of alike nodes in two classes, of all pairs of nodes of buckets (key, id).

    In each bucket a class of more than BLOCK nodes has blocks of its own, and the other classes share blocks. A cell compares two
    blocks, unless both are of one class, so a text is copied once for each block it meets and not for each node.
    """
    told = buckets.join(labels, "id", "left").select("key", "id", F.coalesce("class", "id").alias("class"))
    open_ = told.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least != most")
    told = stored(told.join(open_.select("key"), "key", "left_semi"), "told")
    sizes = told.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n")).withColumn("own", F.expr(f"if(n > {BLOCK}, string(class), '*')"))
    parts = sizes.groupBy("key", "own").agg(F.expr(f"(sum(n) - 1) div {BLOCK} + 1").alias("parts"))
    placed = told.join(sizes.join(parts, ["key", "own"]).select("key", "class", "own", "parts"), ["key", "class"])
    placed = stored(placed.select("key", "id", "class", "own", F.pmod(F.xxhash64("id"), "parts").alias("part")), "blocks")
    blocks = placed.select("key", "own", "part").distinct()
    one, two = (blocks.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("own", "part"))) for k in (1, 2))
    cells = one.join(two, "key").where("own_1 < own_2 or own_1 = '*' and own_2 = '*' and part_1 <= part_2").withColumn("cell", F.concat_ws(" ", "key", "own_1", "part_1", "own_2", "part_2"))
    sides = cells.select("key", F.col("own_1").alias("own"), F.col("part_1").alias("part"), "cell", F.lit(True).alias("left"))
    sides = sides.unionByName(cells.where("own_1 != own_2 or part_1 != part_2").select("key", F.col("own_2").alias("own"), F.col("part_2").alias("part"), "cell", F.lit(False).alias("left")))
    rows = sides.join(placed, ["key", "own", "part"]).join(texts.select("id", "text"), "id").select("cell", "id", "class", "left", "text")

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        at, held = None, []
        for x in batches:
            cells, ids, classes, lefts = (c.to_pylist() for c in x.columns[:4])
            texts = as_bytes(x.column(4))
            for s, e in small_chunks([len(t) for t in texts]):
                hashes, tf, starts = features(texts[s:e])
                w = tf * idf.value[bucket(hashes)].astype(np.float64)
                for i in range(s, e):
                    if cells[i] != at:
                        if found := between(held, similarity):
                            yield batch(schema, *zip(*found, strict=True))
                        at, held = cells[i], []
                    own = slice(starts[i - s], starts[i - s + 1])
                    held.append((ids[i], classes[i], lefts[i], hashes[own].copy(), w[own].copy()))
        if found := between(held, similarity):
            yield batch(schema, *zip(*found, strict=True))

    return arrow_map(rows.repartition("cell").sortWithinPartitions("cell"), run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, class) of every node of edges (a, b): the smallest id it is linked to, over any number of links."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "stars")
        parents = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        # Done when every node has one parent and no parent has one.
        if not edges.join(parents, "u").join(edges.select(F.col("u").alias("v"), F.lit(1).alias("child")).distinct(), "v", "left").where("n > 1 or child = 1").limit(1).count():
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("class")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("class")).distinct())


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The classes of labels, with links (a, b) between them."""
    return components(labels.where("id != class").select(F.col("id").alias("a"), F.col("class").alias("b")).unionByName(links))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, text_id (the smallest id with the same text), copies (rows with the same text) of every row."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    idf = spark.sparkContext.broadcast(inverse_frequencies(rows))
    bands = stored(node_bands(rows, idf), "bands")
    nodes = stored(bands.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "nodes")
    keyed = nodes.where("id is not null").select("id", F.explode("bands").alias("key")).distinct()
    leads = [F.min(F.struct(F.xxhash64("id", F.lit(k)), "id"))["id"].alias(f"lead_{k}") for k in range(LEADERS)]
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.array(*leads).alias("leads")).where("size > 1")
    members = stored(keyed.join(shared, "key"), "members")
    inside = nodes.join(members.select("id").distinct(), "id", "left_semi").select("id", "digest")
    addressed = rows.select(F.col("doc_id").alias("id"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "text")
    texts = stored(addressed.join(inside, ["id", "digest"], "left_semi"), "texts")

    few = members.where(f"size <= {SMALL}")
    every = few.select("key", F.col("id").alias("a")).join(few.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b")
    many = members.where(f"size > {SMALL}")
    led = many.select(F.explode(F.array_distinct("leads")).alias("a"), F.col("id").alias("b")).where("a != b")
    labels = stored(components(verified(stored(led.unionByName(every).distinct(), "pairs"), texts, idf, similarity)), "labels")
    many = many.select("key", "id")
    found = stored(across(many, labels, texts, idf, similarity), "links")
    if found.limit(1).count():
        labels = stored(joined(labels, found), "labels")
    named = nodes.select("digest", "id", "copies").join(labels, "id", "left").select("digest", F.coalesce("class", "id").alias("class_id"), F.col("id").alias("text_id"), "copies")
    return bands.select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id", "text_id", "copies")


def op2_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
