"""Operator 5: token ids in binary shards, compressed by a Re-Pair grammar.

Documents are range-partitioned and sorted by id; every partition writes shards of about ``SHARD_IDS`` ids. In a shard the pair
that occurs most often, by exact counts, is replaced everywhere by a new nonterminal, again and again until no pair occurs
``FREQUENT`` times (ties: the pair that was found first, together with those of the same count that can't overlap it). All places
are rewritten at once, in arrays. Pairs never cross a document's end, so a document, or any stretch of one, decodes without the others: rules carry their expansion lengths.

A shard's bytes (little-endian): magic ``PMRP``, version, then 64-bit counts (documents, ids, terminals, rules, symbols); per
document its id (64-bit, with a validity byte), its count of ids and of symbols; per rule its left and right symbol and expansion
length (32-bit); the symbols (16-bit if all fit, else 32-bit). Shards are rows (part, shard, before, n_docs, n_ids, blob) of a
Parquet table, which is how Spark's writers put binary files into any shared store and commit them whole.

Defined results: a null text counts as empty and has the end id alone; a null id sorts first; rows with the same id lie beside
each other, ordered by text; an empty table gives no shards. Only the id and text columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_map, as_texts, batch, chunks, scratch
from pagemill.llm.words import encoder

SHARD_IDS = 1 << 22
#: Characters that are encoded at once: the more there are, the more often a word occurs among them.
ENCODE_CHARS = 1 << 22
#: A pair is replaced while it occurs so often in its shard: a rule takes 12 bytes, and each use saves a symbol of 2 (or 4).
FREQUENT = 32
MAGIC, VERSION = b"PMRP", 1
HEAD = struct.Struct("<4sIqqqqq")
SHARDS = "part int, shard int, before long, n_docs long, n_ids long, blob binary"


def groups(keys: np.ndarray, at: np.ndarray, frequent: int) -> list[tuple[int, np.ndarray]]:
    """(key, its positions in ascending order) of the keys that occur so often; keys aren't negative, positions ascend for each key."""
    n = len(keys)
    if n < frequent:
        return []
    bits = int(at.max()).bit_length()
    if int(keys.max()).bit_length() + bits < 64:
        both = keys << bits
        both |= at
        both.sort()
        at = both & ((1 << bits) - 1)
        both >>= bits
        keys = both
    else:
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
    # A key occurs so often where it still stands so many places further on.
    start, found = np.flatnonzero(keys[frequent - 1 :] == keys[: n - frequent + 1]), []
    if len(start):
        start = start[np.concatenate(([True], keys[start[1:]] != keys[start[:-1]]))]
        end = np.searchsorted(keys, keys[start], "right")
        found = [(k, at[i:j].copy()) for k, i, j in zip(keys[start].tolist(), start.tolist(), end.tolist(), strict=True)]
    return found


def grammar(ids: np.ndarray, counts: np.ndarray, terminals: int, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols of each document, rules as rows (left, right) in order of depth, expansion lengths of the rules)."""
    n = len(ids)
    # Live positions are a linked list for each document; n stands for no position, -1 for a symbol that is gone.
    seq, after, before = np.append(ids.astype(np.int32), np.int32(-1)), np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    ends = np.cumsum(counts)[counts > 0]
    starts = np.concatenate(([0], ends[:-1])) if n else ends
    after[ends - 1], before[starts] = n, n
    wide = (terminals + n // frequent).bit_length()
    inside = np.flatnonzero(after[:n] < n)
    pairs = seq[inside].astype(np.int64)
    pairs <<= wide
    pairs |= seq[1:][inside]
    held = dict(groups(pairs, inside, frequent))
    del pairs, inside
    # Pairs by their counts. No pair of older symbols arises later, so counts only fall, and new pairs occur no more often than the
    # pair that made them: the greatest count falls steadily, and a pair whose count is out of date is moved when its turn comes.
    by_count: dict[int, list[int]] = {}
    for key, at in held.items():
        by_count.setdefault(len(at), []).append(key)
    rules: list[tuple[int, int]] = []
    lengths: list[int] = []
    depths: list[int] = []
    mask = (1 << wide) - 1
    for queued in range(max(by_count, default=0), frequent - 1, -1):
        turn = by_count.pop(queued, [])
        while turn:
            # Pairs that can't overlap, no left symbol being another's right one, don't change each other's counts: they take their turn together.
            together, later, lefts, rights = [], [], set(), set()
            for key in turn:
                left, right = key >> wide, key & mask
                if left in rights or right in lefts or (left == right and together):
                    later.append(key)
                    continue
                together.append(key)
                lefts.add(left)
                rights.add(right)
                if left == right:
                    later += turn[len(together) + len(later) :]
                    break
            turn = later
            places = [held.pop(k) for k in together]
            sizes, keys = np.fromiter(map(len, places), np.int64, len(places)), np.array(together)
            at = np.concatenate(places) if len(places) > 1 else places[0]
            left, right = (np.repeat(keys >> wide, sizes), np.repeat(keys & mask, sizes)) if len(places) > 1 else (together[0] >> wide, together[0] & mask)
            stays = seq.take(at) == left
            stays &= seq.take(after.take(at)) == right
            if len(places) == 1 and left == right:  # of a run of one symbol every second place
                at = at[stays]
                first = np.concatenate((np.ones(min(1, len(at)), bool), after[at[:-1]] != at[1:]))
                index = np.arange(len(at))
                stays = (index - np.maximum.accumulate(np.where(first, index, 0))) % 2 == 0
                if (now := int(np.count_nonzero(stays))) < queued:
                    if now >= frequent:
                        held[together[0]] = at
                        by_count.setdefault(now, []).append(together[0])
                    continue
                where, new = at[stays], together
            else:
                upto = np.cumsum(sizes) - sizes
                counted = np.add.reduceat(stays, upto, dtype=np.int64)
                full = counted >= queued
                for k in np.flatnonzero(~full & (counted >= frequent)).tolist():  # these have lost places since
                    s, e, now = int(upto[k]), int(upto[k] + sizes[k]), int(counted[k])
                    held[together[k]] = at[s:e][stays[s:e]]
                    by_count.setdefault(now, []).append(together[k])
                if not full.all():
                    stays &= np.repeat(full, sizes)
                where, new = at[stays], keys[full].tolist()
            if not new:
                continue
            base = terminals + len(rules)
            for key in new:
                pair = key >> wide, key & mask
                rules.append(pair)
                lengths.append(sum(1 if x < terminals else lengths[x - terminals] for x in pair))
                depths.append(1 + max(0 if x < terminals else depths[x - terminals] for x in pair))
            made = np.repeat(np.arange(base, base + len(new)), queued) if len(new) > 1 else base
            gone = after.take(where)
            follow = after.take(gone)
            seq[where], seq[gone], after[where], before[follow] = made, -1, follow, where
            ahead = before.take(where)
            one, two = seq.take(ahead).astype(np.int64), seq.take(follow).astype(np.int64)
            # The new symbols' neighbours; where two new ones lie side by side, the pair is that of the first and what follows it.
            ok_one, ok_two = (one >= 0) & (one < base), two >= 0
            pairs = np.concatenate(((one << wide | made)[ok_one], (made << wide | two)[ok_two]))
            for fresh, at in groups(pairs, np.concatenate((ahead[ok_one], where[ok_two])), frequent):
                held[fresh] = at
                (turn if len(at) == queued else by_count.setdefault(len(at), [])).append(fresh)
    alive = seq[:n] >= 0
    per = np.zeros(len(counts), np.int64)
    if n:
        per[counts > 0] = np.add.reduceat(alive, starts, dtype=np.int64)
    order = np.argsort(depths, kind="stable")
    name = np.arange(terminals + len(rules))
    name[terminals + order] = np.arange(terminals, terminals + len(rules))
    table = name[np.array(rules, np.int64).reshape(-1, 2)[order]] if rules else np.empty((0, 2), np.int64)
    return name[seq[:n][alive]], per, table, np.array(lengths, np.int64)[order] if rules else np.empty(0, np.int64)


def write_shard(doc_ids: list, counts: np.ndarray, ids: np.ndarray, terminals: int) -> bytes:
    symbols, per, rules, lengths = grammar(ids, counts, terminals)
    kind = "<u2" if terminals + len(rules) <= 1 << 16 else "<u4"
    return b"".join((
        HEAD.pack(MAGIC, VERSION, len(counts), len(ids), terminals, len(rules), len(symbols)),
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        counts.astype("<i8").tobytes(),
        per.astype("<i8").tobytes(),
        rules.astype("<u4").tobytes(),
        lengths.astype("<u4").tobytes(),
        symbols.astype(kind).tobytes(),
    ))


class Shard:
    """A shard's documents, each decoded on its own."""

    def __init__(self, blob: bytes):
        magic, version, docs, self.n_ids, self.terminals, rules, symbols = HEAD.unpack_from(blob)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of this format")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        valid = take("u1", docs)
        self.doc_ids = [int(d) if v else None for d, v in zip(take("<i8", docs), valid, strict=True)]
        self.counts, self.per = take("<i8", docs), take("<i8", docs)
        self.rules, self.lengths = take("<u4", 2 * rules).reshape(-1, 2).astype(np.int64), take("<u4", rules).astype(np.int64)
        self.symbols = take("<u2" if self.terminals + rules <= 1 << 16 else "<u4", symbols)
        self.first = np.concatenate(([0], np.cumsum(self.per)))
        self.expand_rules()

    def expand_rules(self) -> None:
        """Every rule's ids, in one array."""
        ends = np.concatenate(([0], np.cumsum(self.lengths)))
        flat, done = np.empty(ends[-1], np.uint32), 0
        while done < len(self.rules):  # a run of rules whose parts are done
            upto = done + 1
            later = np.flatnonzero(self.rules[done:].max(1) >= self.terminals + done)
            upto = done + int(later[0]) if len(later) else len(self.rules)
            part = self.rules[done:upto].reshape(-1)
            flat[ends[done] : ends[upto]] = self.gather(part, flat, ends)
            done = upto
        self.flat, self.ends = flat, ends

    def gather(self, symbols: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(self.rules):
            return symbols.astype(np.uint32)
        rule = symbols.astype(np.int64)
        rule -= self.terminals
        where = np.flatnonzero(rule >= 0)
        rule = rule[where]
        lens = self.lengths[rule]
        # Every symbol is copied once for each of its ids; those of rules are then overwritten.
        out = np.repeat(symbols, self.repeats(symbols, where, lens)).astype(np.uint32)
        starts = where + np.cumsum(lens - 1) - (lens - 1)
        index = np.repeat(starts - (np.cumsum(lens) - lens), lens)
        index += np.arange(len(index))
        source = np.repeat(ends[rule] - (np.cumsum(lens) - lens), lens)
        source += np.arange(len(source))
        out[index] = flat[source]
        return out

    @staticmethod
    def repeats(symbols: np.ndarray, where: np.ndarray, lens: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        out[where] = lens
        return out

    def all_ids(self) -> np.ndarray:
        return self.gather(self.symbols, self.flat, self.ends)

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the shard's k-th document; only symbols that cover them are expanded."""
        symbols = self.symbols[self.first[k] : self.first[k + 1]].astype(np.int64)
        stop = int(self.counts[k]) if stop is None else min(stop, int(self.counts[k]))
        lens = np.where(symbols < self.terminals, 1, self.lengths[np.maximum(symbols - self.terminals, 0)] if len(self.lengths) else 1)
        to = np.cumsum(lens)
        a, b = np.searchsorted(to, start, "right"), np.searchsorted(to, stop, "left") + 1
        return self.gather(symbols[a:b], self.flat, self.ends)[start - (to[a] - lens[a]) if a < len(to) else 0 :][: max(0, stop - start)]


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = public_tokenizers.path("word_bpe_49k.json"), end_id: int = 2, partitions: int | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of all documents, in ascending order of id, as a table of shards at path."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("blob", pa.binary())])
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held, words = 0, encoder(tokenizer)

        def flush():
            nonlocal doc_ids, counts, ids, held, shard, before
            blob = write_shard(doc_ids, np.concatenate(counts), np.concatenate(ids), max(words.size, end_id + 1))
            out = batch(schema, [part], [shard], [before], [len(doc_ids)], [held], [blob])
            shard, before = shard + 1, before + held
            doc_ids, counts, ids, held = [], [], [], 0
            return out

        for b in batches:
            names, texts = b.column(0).to_pylist(), as_texts(b.column(1))
            for s, e in chunks([len(t) for t in texts], ENCODE_CHARS):
                got, n = words.encode_batch(texts[s:e], end_id)
                upto, first = np.concatenate(([0], np.cumsum(n))), 0
                while first < len(n):  # documents until the shard is full
                    last = min(len(n), int(np.searchsorted(upto, upto[first] + shard_ids - held)))
                    doc_ids += names[s + first : s + last]
                    counts.append(n[first:last])
                    ids.append(got[upto[first] : upto[last]])
                    held += int(upto[last] - upto[first])
                    first = last
                    if held >= shard_ids:
                        yield flush()
        if doc_ids:
            yield flush()

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Texts' beginnings tell apart rows without an id or with the same one, which would else all go to one task.
    begin = F.substring("text", 1, 64).asc_nulls_first()
    ordered = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), begin).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    arrow_map(ordered, run, SHARDS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards at path."""
    shards = spark.read.schema(SHARDS).parquet(path)
    # One row for each partition that wrote: what lies before it.
    sums = {r[0]: r[1] for r in shards.groupBy("part").agg(F.sum("n_ids")).collect()}
    before, upto = {}, 0
    for p in sorted(sums):
        before[p], upto = upto, upto + sums[p]

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for b in batches:
            for part, ahead, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                shard = Shard(blob)
                ids, ends = shard.all_ids().astype("<u4"), np.cumsum(shard.counts)
                starts = ends - shard.counts
                raw = memoryview(ids.tobytes())
                yield batch(schema, shard.doc_ids, starts + before[part] + ahead, shard.counts, [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])

    return arrow_map(shards.select("part", "before", "blob"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_files(spark, path)
