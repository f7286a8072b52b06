"""Operator 1: byte-level BPE encoding and decoding with a pair occurrence index.

All distinct pre-tokens of a stretch of a partition that aren't yet known lie in one array of symbols. An index maps every adjacent
pair that has a rank to all its positions. Active ranks are applied in ascending order: the positions of the lowest are merged from
left to right, and the two neighbouring pairs of each merge move to their new lists. A stretch holds ``INDEX_CHARS`` of text (one
longer text is a stretch of its own), so that an index has a bounded size. What a pre-token became is kept for the next stretches,
in a cache that starts anew when it is full, by its pre-tokens or by their characters, so memory doesn't grow with the input.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty text; repeated rows give repeated
results; other columns of the input are neither read nor returned; whole texts are encoded, however long.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.common import arrow_map, as_texts, batch, chunks

CACHE_WORDS, CACHE_CHARS = 700_000, 16_000_000
#: Characters of the texts whose unknown pre-tokens share one index.
INDEX_CHARS = 1 << 22
#: How byte-level BPE vocabularies split a text (GPT-2's published pattern) and spell its bytes.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
ENCODED = "doc_id long, ids array<int>"


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte."""
    rest = iter(range(256, 512))
    return {b: chr(b if b in set(PRINTABLE) else next(rest)) for b in range(256)}


class PairIndexBpe:
    """An encoder and decoder for a byte-level BPE vocabulary in the file format of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab, self.special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = [vocab[letters[b]] for b in range(256)]
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        #: (left << 20 | right) -> rank, and what each rank makes.
        self.ranks, self.made = {}, []
        for rank, (a, b) in enumerate(x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]):
            self.ranks[vocab[a] << 20 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        back = {c: b for b, c in letters.items()}
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.by_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends, self.chars = array("I"), array("Q", [0]), 0

    def merge_all(self, words: Iterable[bytes]) -> list[list[int]]:
        """Ids of each word; all words share one pair occurrence index."""
        first, ranks, made = self.first, self.ranks, self.made
        symbols: list[int] = [-1]
        spans = []
        for w in words:
            spans.append(len(symbols))
            symbols += [first[b] for b in w]
            symbols.append(-1)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        find = ranks.get
        a = -1
        for i, b in enumerate(symbols):
            if a >= 0 and b >= 0 and (r := find(a << 20 | b)) is not None:
                if r in index:
                    index[r].append(i - 1)
                else:
                    index[r] = [i - 1]
            a = b
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            positions = index.pop(rank)
            positions.sort()
            new, pair = made[rank], None
            for i in positions:
                a = symbols[i]
                if a < 0:
                    continue
                j = after[i]
                b = symbols[j]
                if b < 0:
                    continue
                if pair is None:
                    if find(a << 20 | b) != rank:
                        continue
                    pair = (a, b)
                elif a != pair[0] or b != pair[1]:
                    continue
                symbols[i], symbols[j] = new, -2
                after[i] = k = after[j]
                before[k] = i
                c = symbols[k]
                if c >= 0 and (r := find(new << 20 | c)) is not None:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                        heapq.heappush(active, r)
                h = before[i]
                c = symbols[h]
                if c >= 0 and (r := find(c << 20 | new)) is not None:
                    if r in index:
                        index[r].append(h)
                    else:
                        index[r] = [h]
                        heapq.heappush(active, r)
        out = []
        for s, e in zip(spans, [*spans[1:], n], strict=True):
            out.append([x for x in symbols[s : e - 1] if x >= 0])
        return out

    def units(self, text: str) -> list[str]:
        """Pieces of text whose ids, one after another, are the ids of text."""
        words = text.split()
        gaps = len(words) - 1
        if gaps >= 0 and sum(map(len, words)) + gaps == len(text) and text.count(" ") + (lines := text.count("\n")) == gaps:
            # Single spaces and line feeds alone stand between words: a space belongs to the word after it.
            if not lines:
                return [words[0], *[" " + w for w in words[1:]]]
            out = []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                out += ["\n", first]
                out += [" " + w for w in rest]
            return out[1:]
        return SPLIT.findall(text)

    def lookup(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts in order, and how many each text has."""
        if len(self.known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.forget()
        parts: list[list[str]] = []
        for t in texts:
            if self.by_special and "<|" in t and self.by_special.search(t):
                got, at = [], 0
                for m in self.by_special.finditer(t):
                    got += [*self.units(t[at : m.start()]), m[0]] if m.start() > at else [m[0]]
                    at = m.end()
                parts.append(got + (self.units(t[at:]) if at < len(t) else []))
            else:
                parts.append(self.units(t) if t else [])
        known = self.known
        fresh = dict.fromkeys(u for p in parts for u in p if u not in known)
        if fresh:
            pieces, owner = [], []
            for k, u in enumerate(fresh):
                cut = [u] if u in self.special else SPLIT.findall(u)
                pieces += cut
                owner += [k] * len(cut)
            distinct = dict.fromkeys(pieces)
            plain = [p for p in distinct if p not in self.special]
            ids = {t: [i] for t, i in self.special.items()}
            ids.update(zip(plain, self.merge_all(p.encode() for p in plain), strict=True))
            self.chars += sum(map(len, fresh))
            base, flat, ends, at = len(self.ends) - 1, self.flat, self.ends, 0
            for k, u in enumerate(fresh):
                known[u] = base + k
                while at < len(owner) and owner[at] == k:
                    flat.extend(ids[pieces[at]])
                    at += 1
                ends.append(len(flat))
        at = np.fromiter((known[u] for p in parts for u in p), np.int64, sum(map(len, parts)))
        ends, flat = np.frombuffer(self.ends, np.uint64).astype(np.int64), np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.empty(0, np.uint32)
        starts, lens = ends[:-1][at], np.diff(ends)[at]
        to = np.cumsum(lens)
        out = flat[np.repeat(starts - (to - lens), lens) + np.arange(to[-1] if len(to) else 0)]
        upto = np.concatenate(([0], to))
        counts = np.diff(upto[np.concatenate(([0], np.cumsum([len(p) for p in parts])))])
        return out, counts

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        for a, b in chunks([len(t) for t in texts], INDEX_CHARS):
            ids, counts = self.lookup(texts[a:b])
            yield from np.split(ids, np.cumsum(counts)[:-1])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_CODERS: dict[str, PairIndexBpe] = {}


def coder(path: str) -> PairIndexBpe:
    """One per Python worker."""
    if path not in _CODERS:
        _CODERS[path] = PairIndexBpe(path)
    return _CODERS[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    """doc_id, ids of every row of docs."""

    def run(batches):
        kind = pa.list_(pa.field("element", pa.int32()))
        schema = pa.schema([("doc_id", pa.int64()), ("ids", kind)])
        for b in batches:
            texts = as_texts(b.column(1))
            for s, e in chunks([len(t) for t in texts], 1 << 23):
                ids = list(coder(tokenizer).encode_batch(texts[s:e]))
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                yield batch(schema, b.column(0).slice(s, e - s), pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32), flat, type=kind))

    return arrow_map(docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")), run, ENCODED)


def decode(encoded: DataFrame, tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
        for b in batches:
            bpe, ids = coder(tokenizer), b.column(1)
            for i in range(0, len(ids), 256):
                part = ids.slice(i, 256)
                yield batch(schema, b.column(0).slice(i, 256), [bpe.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in part])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and same (whether the decoded text is the text), in one pass without a shuffle."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("same", pa.bool_())])
        for b in batches:
            bpe, texts = coder(tokenizer), as_texts(b.column(1))
            counts, hashes, decoded, same = [], [], [], []
            for t, ids in zip(texts, bpe.encode_batch(texts), strict=True):
                back = bpe.decode(ids)
                counts.append(len(ids))
                hashes.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == t)
            yield batch(schema, b.column(0), counts, hashes, decoded, same)

    return arrow_map(docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
