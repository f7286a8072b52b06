"""Operator 6: vector bin packing of documents into training sequences by the dot-product heuristic.

An example asks for tokens, one segment and loss-bearing tokens; a sequence has limits on all three. Of the examples that fit in
an open sequence, the one with the greatest dot product of its demand and what is left, both as shares of the limits, goes in.
When none fits, the largest is cut so that its first part fills the sequence, unless less than ``LEAST_CUT`` tokens would go in.
Examples over a limit are cut beforehand. Each task packs its own partition, holding ``POOL`` examples at a time, so nothing is
shuffled and memory is bounded; what is left at a task's end becomes sequences whose lengths are powers of two, without padding.

Defined results: a null text counts as empty and has the end id alone; repeated rows are packed as documents of their own; an
empty table gives no rows. Only the named columns are read. ``prompt_col``, if given, counts the leading ids that bear no loss
(null: none).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_map, as_texts, batch, chunks
from pagemill.llm.words import ENCODE_CHARS, encoder

POOL, LEAST_CUT = 2048, 8
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment int, loss_tokens long, ids array<int>"


class Packer:
    """Packs examples that come one after another. A piece is [doc, start, ids, doc_tokens, prompt]."""

    def __init__(self, tokens: int, segments: int, loss: int, first_id: int = 0):
        self.tokens, self.segments, self.loss, self.next_id = tokens, segments, loss, first_id
        self.pool: list[list] = []
        self.need = np.empty((0, 2))

    def cut(self, start: int, n: int, prompt: int) -> int:
        """Ids of the longest piece from start that a sequence takes."""
        return min(n - start, self.tokens, max(0, prompt - start) + self.loss)

    def add(self, doc, ids: np.ndarray, prompt: int) -> Iterator[list]:
        start, n = 0, len(ids)
        fresh = []
        while start < n:
            k = self.cut(start, n, prompt)
            piece = [doc, start, ids[start : start + k], n, prompt]
            if k == self.tokens:
                yield from self.close([piece])
            else:  # a copy: a view would keep the ids of its whole batch alive
                piece[2] = piece[2].copy()
                fresh.append(piece)
            start += k
        self.pool += fresh

    def loss_of(self, piece: list) -> int:
        return max(0, piece[1] + len(piece[2]) - max(piece[1], piece[4]))

    def close(self, pieces: list[list]) -> Iterator[list]:
        offset = 0
        for k, p in enumerate(pieces):
            yield [*p[:4], self.next_id, offset, k, self.loss_of(p)]
            offset += len(p[2])
        self.next_id += 1

    def fill(self, least: int) -> Iterator[list]:
        """Closes full sequences while more than least examples wait."""
        need = np.array([(len(p[2]), self.loss_of(p)) for p in self.pool], float).reshape(-1, 2)
        alive, left = np.ones(len(need), bool), len(need)
        scale = np.array([1 / self.tokens**2, 1 / max(1, self.loss) ** 2])
        while left > least:
            room, room_loss, inside = self.tokens, self.loss, []
            while room and len(inside) < self.segments and left:
                fits = alive & (need[:, 0] <= room) & (need[:, 1] <= room_loss)
                if fits.any():
                    k = int(np.argmax(np.where(fits, need @ (scale * (room, room_loss)), -1.0)))
                    piece = self.pool[k]
                    alive[k] = False
                    left -= 1
                else:
                    k = int(np.argmax(np.where(alive, need[:, 0], -1.0)))
                    doc, start, ids, n, prompt = self.pool[k]
                    size = min(len(ids) - 1, room, max(0, prompt - start) + room_loss)
                    if size < LEAST_CUT:
                        break
                    piece = [doc, start, ids[:size], n, prompt]
                    self.pool[k] = rest = [doc, start + size, ids[size:], n, prompt]
                    need[k] = len(rest[2]), self.loss_of(rest)
                inside.append(piece)
                room, room_loss = room - len(piece[2]), room_loss - self.loss_of(piece)
            if not left and room:
                yield from self.tail(inside)
            else:
                yield from self.close(inside)
        self.pool = [p for p, a in zip(self.pool, alive.tolist(), strict=True) if a]

    def tail(self, pieces: list[list]) -> Iterator[list]:
        """The last ids, in sequences whose lengths are powers of two."""
        left = sum(len(p[2]) for p in pieces)
        while left:
            size, inside = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                doc, start, ids, n, prompt = pieces[0]
                k = min(size, len(ids))
                inside.append([doc, start, ids[:k], n, prompt])
                size -= k
                if k == len(ids):
                    pieces = pieces[1:]
                else:
                    pieces = [[doc, start + k, ids[k:], n, prompt], *pieces[1:]]
            yield from self.close(inside)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, tokens: int = 2048, segments: int = 64, loss: int = 2048, end_id: int = 1, tokenizer: str = public_tokenizers.path("word_bpe_49k.json"), with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, segment, loss_tokens, ids (null unless with_ids)."""
    if min(tokens, segments, loss) < 1:
        raise ValueError("limits are positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kind = pa.list_(pa.field("element", pa.int32()))
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("segment", pa.int32()), ("loss_tokens", pa.int64()), ("ids", kind)])
        packer, words, rows = Packer(tokens, segments, loss, TaskContext.get().partitionId() << 36), encoder(tokenizer), []

        def out(rows):
            crcs = [zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows]
            cols = list(zip(*rows, strict=True))
            ids = pa.array([r[2].astype(np.int32) for r in rows], kind) if with_ids else pa.nulls(len(rows), kind)
            return batch(schema, cols[0], cols[1], [len(x) for x in cols[2]], crcs, cols[3], cols[4], cols[5], cols[6], cols[7], ids)

        for b in batches:
            names, texts, prompts = b.column(0).to_pylist(), as_texts(b.column(1)), b.column(2).to_pylist()
            for s, e in chunks([len(t) for t in texts], ENCODE_CHARS):
                got, n = words.encode_batch(texts[s:e], end_id)
                for name, ids, prompt in zip(names[s:e], np.split(got, np.cumsum(n)[:-1]), prompts[s:e], strict=True):
                    rows += packer.add(name, ids, prompt or 0)
                    if len(packer.pool) >= POOL:
                        rows += packer.fill(POOL // 2)
                    if len(rows) >= 512:
                        yield out(rows)
                        rows = []
        rows += packer.fill(0)
        if rows:
            yield out(rows)

    prompt = docs[prompt_col].cast("long") if prompt_col else F.lit(0).cast("long")
    return arrow_map(docs.select(docs[id_col].cast("long"), docs[text_col].cast("string"), prompt), run, PIECES)


def first_line_words(text: Column) -> Column:
    """Words of the first line of a text that has more lines, else 0: that line counts as a prompt, and bears no loss."""
    line = F.trim(F.substring_index(text, "\n", 1))
    return F.when(F.instr(text, "\n") > 0, F.size(F.filter(F.split(line, r"\s+"), lambda x: x != ""))).otherwise(0)


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs.withColumn("prompt", first_line_words(F.col("text"))), prompt_col="prompt", with_ids=False).drop("ids")
