"""Ids by the tokenizers library for a vocabulary that drops white space, each distinct word encoded once.

The vocabulary's pattern never matches across white space and its normaliser (NFC, white space to spaces, lower case) neither
joins nor reorders characters across it, so the ids of a text are those of its stretches between spaces, one after another, and
those of a stretch are its pre-tokens'. A cache holds the ids of stretches that a task has met; the library encodes the distinct
pre-tokens of the others, many in one call. A full cache (by stretches or by their characters) keeps those met again, at most
half of its size and none that is long, so memory doesn't grow with the input.

Stretches with characters from U+0250 on (where normalisation and letter classes are the library's business), with control
strings, or of texts with U+0000 or U+001C to U+001F (white space to Python alone) go to the library whole.
"""

from __future__ import annotations

import json
import os
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Limits of the cache: stretches, their characters, and the longest that stays when it is full.
CACHE_STRETCHES, CACHE_CHARS, LONGEST = 400_000, 8_000_000, 256
#: Characters of the texts that are encoded at once.
ENCODE_CHARS = 1 << 19
#: Characters that Python's split takes for white space and the vocabulary's pattern doesn't, and the mark between stretches.
ODD = "\x00\x1c\x1d\x1e\x1f"
TOGETHER = 256
MARKS = (",", ".")


class StretchEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.whole = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.special = [t["content"] for t in spec["added_tokens"]]
        # Texts may be cut only where the file has exactly the rules described above.
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.may_cut = bool(self.end) and len(steps) == 2 and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and steps[1]["type"] == "ByteLevel" and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        if self.may_cut:
            pattern = steps[0]["pattern"]["Regex"]
            self.split = regex.compile("\x00|" + pattern.replace(r"[^\s", "[^\\s\x00"))
            #: The same model without the steps that a pre-token has behind it.
            self.model = Tokenizer.from_file(path)
            self.model.normalizer = normalizers.Sequence([])
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.closes = np.zeros(self.size, bool)
            self.closes[[i for t, i in spec["model"]["vocab"].items() if t.endswith(self.end)]] = True
        self.forget()
        self.forget_words()

    @property
    def library(self):
        """The tokenizer as it is in the file, loaded when a text first needs it."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
            self.whole.no_truncation()
            self.whole.no_padding()
        return self.whole

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends = array("I"), array("Q", [0])
        #: Whether a stretch ends in something other than a letter or digit; how often each was met; characters of all.
        self.open, self.uses, self.chars = bytearray(), np.empty(0, np.int64), 0

    def shrink(self) -> None:
        """Forgets stretches met only once lately, the least used ones beyond half of the cache, and long ones."""
        names = list(self.known)
        lens = np.fromiter(map(len, names), np.int64, len(names))
        uses = np.where(lens > LONGEST, 0, self.grown(len(names)))
        keep = np.flatnonzero(uses > 1)
        if len(keep) > CACHE_STRETCHES // 2:
            keep = np.sort(keep[np.argpartition(-uses[keep], CACHE_STRETCHES // 2)[: CACHE_STRETCHES // 2]])
        ids, counts = gather(np.frombuffer(self.flat, np.uint32), np.frombuffer(self.ends, np.uint64).astype(np.int64), keep)
        marks = np.frombuffer(self.open, np.uint8)[keep].tobytes()
        self.forget()
        self.known = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.flat.frombytes(ids.tobytes())
        self.ends.frombytes(np.cumsum(counts).astype(np.uint64).tobytes())
        self.open, self.uses, self.chars = bytearray(marks), uses[keep] >> 1, int(lens[keep].sum())

    def grown(self, n: int) -> np.ndarray:
        if len(self.uses) < n:
            self.uses = np.concatenate((self.uses, np.zeros(n - len(self.uses), np.int64)))
        return self.uses

    def forget_words(self) -> None:
        """Pre-tokens last for one call of learn."""
        self.words: dict[str, int] = {}
        self.word_flat, self.word_ends = array("I"), array("Q", [0])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, and where each one's end."""
        ids = np.array(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("a word didn't end with one closing token")
        return ids, ends

    def learn_words(self, fresh: list[str]) -> None:
        for i in range(0, len(fresh), TOGETHER):
            part = fresh[i : i + TOGETHER]
            ids, ends = self.encode_words(part)
            base, done = len(self.words), self.word_ends[-1]
            self.words.update(zip(part, range(base, base + len(part)), strict=True))
            self.word_flat.frombytes(ids.tobytes())
            self.word_ends.frombytes((ends + done).astype(np.uint64).tobytes())

    def learn(self, fresh: list[str]) -> None:
        """Adds stretches."""
        quick = [w for w in fresh if (w.isascii() or max(w) < "ɐ") and not ("<|" in w and any(x in w for x in self.special))]
        if len(quick) < len(fresh):
            taken = set(quick)
            for w in fresh:
                if w not in taken:
                    self.add([w], np.array(self.library.encode(w, add_special_tokens=False).ids, np.uint32), None)
        # Small letters alone are one pre-token.
        letters, rest = [], []
        for w in quick:
            (letters if w.islower() and w.isalpha() else rest).append(w)
        for i in range(0, len(letters), TOGETHER):
            part = letters[i : i + TOGETHER]
            ids, ends = self.encode_words(part)
            self.add(part, ids, np.diff(ends, prepend=0))
        if not (quick := rest):
            return
        self.forget_words()
        words = self.words
        found = self.split.findall("\x00".join(quick).lower())
        fresh_words = dict.fromkeys(w for w in found if w not in words)
        fresh_words.pop("\x00", None)
        if fresh_words:
            self.learn_words(list(fresh_words))
        words["\x00"] = -1
        at = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
        del words["\x00"]
        mark = at < 0
        owner = np.cumsum(mark)[~mark]
        ids, lens = gather(np.frombuffer(self.word_flat, np.uint32), np.frombuffer(self.word_ends, np.uint64).astype(np.int64), at[~mark])
        self.add(quick, ids, np.bincount(owner, lens, len(quick)).astype(np.int64))

    def add(self, stretches: list[str], ids: np.ndarray, counts: np.ndarray | None) -> None:
        base, done = len(self.known), self.ends[-1]
        self.known.update(zip(stretches, range(base, base + len(stretches)), strict=True))
        self.chars += sum(map(len, stretches))
        self.open += bytes([w != "" and not w[-1].isalnum() for w in stretches])
        self.flat.frombytes(ids.astype(np.uint32).tobytes())
        self.ends.frombytes((done + np.cumsum([len(ids)] if counts is None else counts)).astype(np.uint64).tobytes())

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all stretches in order, and how many each text has; only the distinct ones become Python objects."""
        split = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh = [names[i] for i in new.tolist()]
            self.learn(fresh)
            number[new] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        return number[coded.indices.to_numpy()], pc.list_value_length(split).to_numpy().astype(np.int64)

    def encode_batch(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts in order, each text's followed by end unless that is None, and how many each text has."""
        tail = [] if end is None else [end]
        if not self.may_cut or any(c in t for t in texts for c in ODD):
            if len(texts) > 1 and self.may_cut:
                parts = [self.encode_batch([t], end) for t in texts]
                return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            got = [x.ids for x in self.library.encode_batch(texts, add_special_tokens=False)]
            return np.fromiter((i for x in got for i in [*x, *tail]), np.uint32), np.array([len(x) + len(tail) for x in got], np.int64)
        if len(self.known) > CACHE_STRETCHES or self.chars > CACHE_CHARS:
            self.shrink()
        shared = [shared_form(t) for t in texts]
        at, counts = self.places(shared)
        marks = [self.known[x] for x in MARKS if x in self.known]
        if marks:
            # A comma or full stop that was set apart from other punctuation belongs to its run: those texts are cut by spaces alone.
            wrong = np.flatnonzero(np.isin(at[1:], marks) & np.frombuffer(self.open, np.uint8)[at[:-1]].astype(bool))
            if len(wrong):
                for k in set(np.searchsorted(np.cumsum(counts), wrong + 1, "right").tolist()):
                    shared[k] = texts[k].strip()
                at, counts = self.places(shared)
        self.grown(len(self.known))[:] += np.bincount(at, minlength=len(self.known))
        flat = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.empty(0, np.uint32)
        ends = np.frombuffer(self.ends, np.uint64).view(np.int64)
        if tail:  # a last stretch of one id
            flat, ends = np.concatenate((flat, np.array(tail, np.uint32))), np.concatenate((ends, [len(flat) + 1]))
            at = np.insert(at, np.cumsum(counts), len(ends) - 2)
            counts += 1
        ids, lens = gather(flat, ends, at)
        upto = np.concatenate(([0], np.cumsum(lens)))
        return ids, np.diff(upto[np.concatenate(([0], np.cumsum(counts)))])


def shared_form(text: str) -> str:
    """Text whose stretches count: Latin-1 texts in lower case, with spaces before the comma or full stop at a stretch's end, which follows by itself: fewer distinct ones."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.strip()
    if "<|" in text:
        return text.strip()
    return text.lower().replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n").strip()


def gather(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat numbered at, joined, and their lengths; run k ends before ends[k + 1]."""
    starts = ends[at]
    lens = ends[at + 1] - starts
    to = np.cumsum(lens)
    index = np.repeat(starts - (to - lens), lens)
    index += np.arange(len(index))
    return flat[index], lens


_ENCODERS: dict[str, StretchEncoder] = {}


def encoder(path: str) -> StretchEncoder:
    """One per Python worker; the library runs on one thread, as tasks have a core each."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = StretchEncoder(path)
    return _ENCODERS[path]
