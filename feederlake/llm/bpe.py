"""Byte-pair encoding with word ends, by an index from every pair of symbols to all of its places."""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederlake.llm.byte_tokens import byte_alphabet
from feederlake.llm.common import map_batches, prepare, row_groups, text_bytes

#: Chunks between white space that a Python worker remembers, and bytes up to which one is remembered.
REMEMBERED, LONGEST = 200_000, 64
#: Bytes of text whose unknown words are merged together.
TOGETHER = 6 << 20
#: Beyond these characters the library normalises and splits; lower case and white space are plain within.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ]")


def _different(places: list[np.ndarray]) -> np.ndarray:
    """All places once, in order."""
    at = np.sort(np.concatenate(places)) if len(places) > 1 else np.sort(places[0])
    return at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) > 1 else at


class WordMerges:
    """Vocabulary and merges of a file for the tokenizers library; encode() and decode() give what that library gives."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocabulary = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.library = tokenizers.Tokenizer.from_file(path)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.alphabet = byte_alphabet()
        shown = {b: c for c, b in self.alphabet.items()}
        self.inner = np.array([vocabulary[shown[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([vocabulary[shown[b] + self.end] for b in range(256)], dtype=np.int64)
        self.size = max([*vocabulary.values(), *self.specials.values()]) + 1
        self.token = [b""] * self.size
        for word, number in [*vocabulary.items(), *self.specials.items()]:
            self.token[number] = word.encode()
        left = np.array([vocabulary[a] for a, _ in model["merges"]], dtype=np.int64)
        right = np.array([vocabulary[b] for _, b in model["merges"]], dtype=np.int64)
        self.left, self.right = left, right
        self.made = np.array([vocabulary[a + b] for a, b in model["merges"]], dtype=np.int64)
        self.pair_order = np.argsort(left * self.size + right, kind="stable")
        self.pair_keys = (left * self.size + right)[self.pair_order]
        # A merge whose product opens a pair of lower rank must not run on ahead within a word.
        lowest = np.full(self.size, len(left), dtype=np.int64)
        np.minimum.at(lowest, left, np.arange(len(left)))
        np.minimum.at(lowest, right, np.arange(len(left)))
        self.stepwise = lowest[self.made] < np.arange(len(left))
        self.known: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 if it is never merged."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_order[at], -1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of every word, as little-endian unsigned 32-bit numbers; no word may be empty."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        symbol = self.inner[data]
        symbol[ends - 1] = self.final[data[ends - 1]]
        after = np.arange(1, len(data) + 1)
        after[ends - 1] = -1
        before = np.arange(-1, len(data) - 1)
        before[ends - sizes] = -1
        alive = np.ones(len(data), dtype=bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Add the places of pairs to the lists of their ranks."""
            rank = self.ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for value, places in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
                if value not in index:
                    index[value] = []
                    heapq.heappush(active, value)
                index[value].append(places)

        note(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            at = _different(index.pop(rank))
            follower = after[at]
            good = alive[at] & (follower >= 0)
            good &= (symbol[at] == self.left[rank]) & (symbol[follower] == self.right[rank])
            at = at[good]
            if self.stepwise[rank] and len(at):
                first = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
                if not first.all():
                    index[rank] = [at[~first]]
                    heapq.heappush(active, rank)
                at = at[first]
            elif self.left[rank] == self.right[rank] and len(at) > 1:
                linked = after[at[:-1]] == at[1:]  # a run of the same symbol: every second place, from the left
                start = np.concatenate(([0], np.flatnonzero(~linked) + 1))
                number = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
                at = at[number % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbol[at] = self.made[rank]
            alive[gone] = False
            after[at] = beyond
            inside = beyond >= 0
            before[beyond[inside]] = at[inside]
            previous = before[at]
            note(_different([at[inside], previous[previous >= 0]]))
        raw = symbol[alive].astype("<u4").tobytes()
        upto = (4 * np.cumsum(np.bincount(word[alive], minlength=len(words)))).tolist()
        return [raw[a:b] for a, b in zip([0, *upto[:-1]], upto, strict=True)]

    def _parts(self, text: str) -> list[bytes | int]:
        """Words of a text outside the plain characters, and special tokens by id."""
        parts: list[bytes | int] = []
        for segment in self.cut.split(text) if self.cut else [text]:
            if segment in self.specials:
                parts.append(self.specials[segment])
            elif segment:
                shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(segment))
                parts += [bytes(self.alphabet[c] for c in word) for word, _ in shown if word]
        return parts

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. All words that are not remembered are merged together, each once."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        plain: dict[int, list[str]] = {}
        other: dict[int, list[bytes | int]] = {}
        for i, text in enumerate(texts):
            if _UNUSUAL.search(text) or any(s in text for s in self.specials):
                other[i] = self._parts(text)
            else:
                plain[i] = text.split()
        fresh = {c: [w.encode() for w in self.split.findall(c.lower())]
                 for c in dict.fromkeys(c for chunks in plain.values() for c in chunks if c not in self.known)}
        merged = self.words
        if len(merged) > REMEMBERED:
            merged = self.words = {}
        words = [w for w in dict.fromkeys([w for ws in fresh.values() for w in ws] + [
            w for parts in other.values() for w in parts if isinstance(w, bytes)]) if w not in merged]
        if words:
            merged.update(zip(words, self.merge(words), strict=True))
        now = {c: b"".join([merged[w] for w in ws]) for c, ws in fresh.items()}
        known = self.known
        out = []
        for i in range(len(texts)):
            if i in plain:
                out.append(b"".join([known[c] if c in known else now[c] for c in plain[i]]))
            else:
                out.append(b"".join([w.to_bytes(4, "little") if isinstance(w, int) else merged[w] for w in other[i]]))
        known.update((c, ids) for c, ids in now.items() if len(c) <= LONGEST)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens with a blank between them, special ones too."""
        token = self.token
        return b" ".join([token[i] for i in ids.tolist()])


@functools.cache
def word_merges(path: str) -> WordMerges:
    """One per Python worker and file."""
    return WordMerges(path)


def encode(docs: DataFrame, vocabulary: str, text_column: str = "text") -> DataFrame:
    """(row, ids): each row of `docs` as a struct, and its ids as little-endian unsigned 32-bit numbers.

    NULL text counts as empty and has no ids. Other columns travel in `row`, whatever their names.
    """

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        data, bounds = text_bytes(batch.column(1))
        for first, last in row_groups(bounds, TOGETHER):
            raw = data[bounds[first]:bounds[last]].tobytes()
            at = (bounds[first:last + 1] - bounds[first]).tolist()
            texts = [raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)]
            ids = pa.array(word_merges(vocabulary).encode(texts), type=pa.binary())
            yield {"row": batch.column(0).slice(first, last - first), "ids": ids}

    prepare(docs.sparkSession, batch_mb=8)
    rows = docs.select(F.struct("*").alias("row"), F.col(text_column).alias("text"))
    return map_batches(rows, per_batch, f"row {rows.schema['row'].dataType.simpleString()}, ids binary")


def decode(coded: DataFrame, vocabulary: str) -> DataFrame:
    """(row, ids, decoded) for what encode() returned, or any other ids in that form; NULL ids decode to nothing."""

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        words = word_merges(vocabulary)
        data, bounds = text_bytes(batch.column(1))
        ids = np.frombuffer(data.tobytes(), dtype="<u4")
        for first in range(0, batch.num_rows, 500):
            at = bounds[first:first + 501] // 4
            texts = [words.decode(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield {"row": batch.column(0).slice(first, 500), "ids": batch.column(1).slice(first, 500),
                   "decoded": pa.array(texts, type=pa.binary()).cast(pa.string())}

    prepare(coded.sparkSession, batch_mb=8)
    return map_batches(coded.select("row", "ids"), per_batch,
                       f"row {coded.schema['row'].dataType.simpleString()}, ids binary, decoded string")
