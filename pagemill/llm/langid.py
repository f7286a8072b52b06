"""Operator 4: language identification by multinomial naive Bayes over hashed character n-grams.

A text becomes the sequence of its letters in lower case with one space for every other stretch; its n-grams of 1 to ``ORDER``
characters are hashed into ``2**BITS`` features. Training counts features for each language over a bounded sample of labelled
rows (``max_train_docs``); the matrix of log probabilities (features x languages, a fixed size for each language) is broadcast.
A batch is a sparse matrix in CSR form, a row of feature numbers for each text, and its scores are that matrix times the log
probabilities. The score of the answer is its posterior probability with the evidence of at most ``EVIDENCE`` n-grams, so long
texts don't all score 1.

Defined results: a text that is null or has no letters is ``und`` with score 0; with no labelled rows to learn from, every text
is ``und``; equal scores go to the first language in order; repeated rows get equal answers. A null id belongs to no fold: it is
not held out and isn't learnt from. Only the id, text and language columns are read, the last for training alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_map, as_texts, batch, chunks

BITS, ORDER, EVIDENCE, SMOOTHING = 16, 4, 24, 0.5
UNKNOWN = "und"
#: Rows to learn from, about; drawn by a hash of the id from all labelled rows outside the held-out fold.
MAX_TRAIN_DOCS = 20_000


def _letter_table() -> np.ndarray:
    """For each code point: its lower-case code point if it is a letter, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Lower-case letters of text, one 0 before, after and between runs of them; empty without letters."""
    if not _TABLE:
        _TABLE.append(_letter_table())
    points = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not len(points):
        return points
    keep = points > 0
    keep[1:] |= points[:-1] > 0
    out = points[keep]
    if not len(out) or not out.any():
        return out[:0]
    return np.concatenate(([0], out, [0] if out[-1] else [])).astype(np.uint32)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """CSR of a batch: feature numbers, and the start of each text's (with the end after the last)."""
    runs = [letters(t) for t in texts]
    joined = np.concatenate([*runs, np.zeros(ORDER, np.uint32)])
    lens = np.fromiter(map(len, runs), np.int64, len(runs))
    ends = np.cumsum(lens)
    n = len(joined) - ORDER
    left = np.repeat(ends, lens) - np.arange(n)  # characters from here to the text's end
    grams = np.empty((n, ORDER), np.int32)
    h = np.zeros(n, np.uint32)
    for k in range(ORDER):
        h = (h + joined[k : n + k] + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        grams[:, k] = (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)
        if k:
            grams[left <= k, k] = -1
    grams[joined[:n] == 0, 0] = -1  # a lone space
    flat = grams.reshape(-1)
    good = flat >= 0
    per = np.concatenate(([0], np.cumsum(good)))
    return flat[good], per[np.concatenate(([0], ends)) * ORDER]


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of rows starts[i] to starts[i + 1]; 0 for none."""
    out = np.zeros((len(starts) - 1, values.shape[1]))
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        out[some] = np.add.reduceat(values, starts[:-1][some], axis=0)
    return out


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, docs: np.ndarray):
        """counts: features x languages; docs: texts of each language."""
        self.languages = languages
        smooth = counts + SMOOTHING
        self.matrix = np.log(smooth / smooth.sum(0)).astype(np.float32) if languages else np.zeros((1 << BITS, 0), np.float32)
        self.prior = np.log((docs + 1) / (docs + 1).sum()) if languages else np.zeros(0)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for a, b in chunks([len(t) for t in texts], 1 << 18):
            index, starts = features(texts[a:b])
            n = np.diff(starts)
            if not self.languages:
                names += [UNKNOWN] * (b - a)
                scores += [0.0] * (b - a)
                continue
            total = segment_sums(self.matrix[index], starts)
            share = (total * np.minimum(1, EVIDENCE / np.maximum(n, 1))[:, None]) + self.prior
            share = np.exp(share - share.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            best = np.argmax(total + self.prior, 1)
            for k, i, x in zip(best.tolist(), n.tolist(), share[np.arange(b - a), best].tolist(), strict=True):
                names.append(self.languages[k] if i else UNKNOWN)
                scores.append(float(x) if i else 0.0)
        return names, scores


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Learns from rows with a language outside the held-out fold, max_train_docs of them on average if there are more."""
    labelled = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    share = max_train_docs / max(1, labelled.count(), max_train_docs)
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("lang", "text").repartition(8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = {}
        for b in batches:
            names, texts = b.column(0).to_pylist(), as_texts(b.column(1))
            for s, e in chunks([len(t) for t in texts], 1 << 20):
                index, starts = features(texts[s:e])
                for lang in set(names[s:e]):
                    own = np.array([x == lang for x in names[s:e]])
                    counts = seen.setdefault(lang, [np.zeros(1 << BITS, np.int64), 0])
                    counts[0] += np.bincount(index[np.repeat(own, np.diff(starts))], minlength=1 << BITS)
                    counts[1] += int(own.sum())
        if seen:
            yield batch(pa.schema([("lang", pa.string()), ("counts", pa.binary()), ("docs", pa.int64())]), list(seen), [c[0].tobytes() for c in seen.values()], [c[1] for c in seen.values()])

    sums: dict[str, list] = {}
    for lang, counts, n in arrow_map(sample, run, "lang string, counts binary, docs long").toLocalIterator():
        own = sums.setdefault(lang, [np.zeros(1 << BITS, np.int64), 0])
        own[0] += np.frombuffer(counts, np.int64)
        own[1] += n
    languages = sorted(sums)
    return Model(languages, np.stack([sums[x][0] for x in languages], 1).astype(float) if languages else np.zeros((1 << BITS, 0)), np.array([sums[x][1] for x in languages], float))


def identify(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of docs, then the predicted language and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    kinds = docs.schema

    def run(batches):
        for b in batches:
            names, scores = shared.value.predict(as_texts(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, pred_col, score_col])

    from pyspark.sql.types import DoubleType, StringType, StructType

    out = StructType([*kinds.fields, *StructType().add(pred_col, StringType()).add(score_col, DoubleType()).fields])
    return arrow_map(docs, run, out)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def crc32_fold(doc_id: int) -> bool:
    """held_out in Python."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
