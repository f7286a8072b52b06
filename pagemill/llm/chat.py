"""Operator 9: chat formatting with offset-aligned loss masks.

A conversation is rendered whole by a template of control strings, encoded once, and its tokens' places are matched with the
sorted spans of its turns by binary search: a token bears loss if it lies in the text of a trained role. The vocabulary is
byte-level, so places come from the tokens' byte lengths; a token that has part of a character's bytes covers the character. The
control strings are added tokens, so no token crosses the edge of a text. A text's own ``<|`` sequences are escaped by a backslash (``<|`` becomes
``<\\|``, ``<\\|`` becomes ``<\\\\|`` and so on), which is undone on reading; no text can then forge a turn.

Turns are sorted within the conversation's partition and rendered as a stream: a conversation longer than ``SEGMENT_CHARS`` is
written in several segments that end between turns, where the encoding of the whole can be cut too, so no conversation has to fit in
memory, and its segments' ids, one after another, are those of the whole. Reading back, only conversations of several segments are
brought together. Defined results: a null text or role counts as empty; turns sort by number (null first), then role, then text, and rows
that repeat stay; rows without a conversation id form one of their own; an empty table gives no rows; other columns are
neither read nor returned.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_map, batch, stored

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
SEGMENT_CHARS = 1 << 20
#: Characters that are encoded in one call.
TOGETHER = 1 << 18
#: Places are kept as small numbers: steps are the starts, each less the one before, and widths the ends less the starts.
FORMATTED = "conv_id long, segment int, last boolean, formatted string, ids array<int>, steps array<int>, widths array<int>, loss binary, turn_starts array<int>, turn_ends array<int>, turn_loss array<boolean>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: Iterable[tuple[str, str]], trained: frozenset[str]) -> tuple[str, list[tuple[int, int, bool]]]:
    """The formatted text of (role, text) rows, and for each the span of its text and whether it bears loss."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
        out += [head, body, END, "\n"]
        spans.append((at + len(head), at + len(head) + len(body), role in trained))
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of a formatted text."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition(MIDDLE)
        turns.append((unescape(role), unescape(rest[: rest.rindex(END)])))
    return turns


def masked(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, bool]]) -> np.ndarray:
    """For each token, whether it lies in the text of a turn that bears loss: one binary search over the sorted spans."""
    if not spans or not len(starts):
        return np.zeros(len(starts), bool)
    first, last, bears = (np.array(x) for x in zip(*spans, strict=True))
    k = np.searchsorted(first, starts, "right") - 1
    at = np.maximum(k, 0)
    return (k >= 0) & bears[at] & (ends <= last[at]) & (starts < last[at])


class ChatEncoder:
    """The tokenizer with the control strings as added tokens, and how many bytes each token stands for."""

    def __init__(self, path: str):
        from tokenizers import AddedToken, Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (START, MIDDLE, END)])
        added = {i: len(t.content.encode()) for i, t in self.library.get_added_tokens_decoder().items()}
        self.width = np.zeros(self.library.get_vocab_size(True), np.int64)
        for token, i in self.library.get_vocab(True).items():
            self.width[i] = added.get(i, len(token))  # a character of an ordinary token stands for a byte

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids, and their starts and ends in code points."""
        for text, got in zip(texts, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.int32)
            to = np.cumsum(self.width[ids])
            raw = np.frombuffer(text.encode(), np.uint8)
            if len(to) and to[-1] != len(raw):
                raise ValueError("the vocabulary isn't byte-level")
            point = np.cumsum((raw & 0xC0) != 0x80)  # 1 for the bytes of the first character
            yield ids, point[to - self.width[ids]] - 1, point[to - 1]


_ENCODERS: dict[str, ChatEncoder] = {}


def chat_encoder(path: str) -> ChatEncoder:
    """One per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChatEncoder(path)
    return _ENCODERS[path]


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = ("assistant",), tokenizer: str = public_tokenizers.path("byte_bpe_50k.json"), segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """FORMATTED: per segment its text, its token ids with their places (code points), the loss mask (a byte for each token) and the spans of its turns."""
    roles = frozenset(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints, flags = pa.list_(pa.field("element", pa.int32())), pa.list_(pa.field("element", pa.bool_()))
        schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int32()), ("last", pa.bool_()), ("formatted", pa.string()), ("ids", ints), ("steps", ints), ("widths", ints), ("loss", pa.binary()), ("turn_starts", ints), ("turn_ends", ints), ("turn_loss", flags)])
        words, waiting, waits = chat_encoder(tokenizer), [], 0
        conv, segment, held, size = None, 0, [], 0

        def close(last: bool) -> None:
            nonlocal waits
            waiting.append((conv, segment, last, *render(held, roles)))
            waits += len(waiting[-1][3])

        def written() -> pa.RecordBatch:
            nonlocal waiting, waits
            rows = []
            for (c, k, last, text, spans), (ids, starts, ends) in zip(waiting, words.encode([x[3] for x in waiting]), strict=True):
                mask = masked(starts, ends, spans).astype(np.uint8).tobytes()
                rows.append((c, k, last, text, ids, np.diff(starts, prepend=0).astype(np.int32), (ends - starts).astype(np.int32), mask, *([s[i] for s in spans] for i in range(3))))
            waiting, waits = [], 0
            return batch(schema, *zip(*rows, strict=True))

        for b in batches:
            for c, _, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if held and (c != conv or size >= segment_chars):
                    close(c != conv)
                    segment, held, size = (segment + 1 if c == conv else 0), [], 0
                    if len(waiting) >= 256 or waits >= min(segment_chars, TOGETHER):
                        yield written()
                conv = c
                held.append((role or "", text or ""))
                size += len(text or "")
        if held:
            close(True)
        if waiting:
            yield written()

    slim = turns.select(turns[conv_col].cast("long").alias("conv_id"), turns[turn_col].cast("long").alias("turn"), turns[role_col].cast("string").alias("role"), turns[text_col].cast("string").alias("text"))
    return arrow_map(slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), run, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens, read from formatted segments alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("loss_tokens", pa.int64())])
        conv, state, rows = None, None, []

        def done():
            rows.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5], state[6]))

        for b in batches:
            for c, segment, text, steps, widths, loss in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if segment == 0:
                    if state:
                        done()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "replace"))
                # Neighbouring loss tokens form stretches of text. Their bytes may share a character, so ends meet or overlap.
                a, on = np.cumsum(np.array(steps, np.int64)), np.frombuffer(loss, np.uint8).astype(bool)
                z = a + np.array(widths, np.int64)
                edge = np.flatnonzero(np.diff(on.astype(np.int8), prepend=0, append=0))
                for s, e in zip(edge[::2], edge[1::2], strict=True):
                    said = unescape(text[a[s] : z[e - 1]])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "replace"))
                state[4] += len(text)
                state[5] += len(on)
                state[6] += int(on.sum())
            if rows:
                yield batch(schema, *zip(*rows, strict=True))
                rows = []
        if state:
            done()
            yield batch(schema, *zip(*rows, strict=True))

    slim = formatted.select("conv_id", "segment", "formatted", "steps", "widths", "loss", "last")
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
    whole, cut = slim.where("segment = 0 and last").drop("last"), slim.where("not (segment = 0 and last)").drop("last")
    return arrow_map(whole, run, kind).unionByName(arrow_map(cut.repartition("conv_id").sortWithinPartitions("conv_id", "segment"), run, kind))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(stored(format_conversations(turns.unionByName(own)), "chat", "zstd"))
