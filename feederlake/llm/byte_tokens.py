"""Ids of a public byte-level vocabulary for many texts, with the common words looked up instead of merged again."""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
import tiktoken
import tokenizers

#: Splits a Latin text into pieces of which each is encoded on its own (fixed value: part of the vocabulary's definition).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered by a Python worker.
REMEMBERED = 400_000
_WIDE_GAP = re.compile(r" \s|\s ")
_NOT_LATIN = re.compile("[^\x00-ɏ]")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself where it is printable, else the next free one."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteTokens:
    """encode() gives the ids that the tokenizers library gives for the vocabulary file, without added tokens.

    A single blank between two other characters always starts a piece of its own, so a Latin text is cut at its blanks
    and each word with its blank is looked up; the unknown words of a batch are encoded together. Texts with wider
    gaps are encoded whole, and texts beyond the Latin blocks, or with a special token in them, by the library.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        self.special = [t["content"] for t in spec["added_tokens"]]
        words = {bytes(alphabet[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        self.plain = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=words, special_tokens={})
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.blank_first = np.zeros(max(words.values()) + 1, dtype=bool)
        self.blank_first[[i for w, i in words.items() if w.startswith(b" ")]] = True
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.plain._core_bpe.encode_ordinary(text)).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode unknown words together and cut the ids where a word begins."""
        for at in range(0, len(words), 20_000):
            own = words[at:at + 20_000]
            ids = np.array(self.plain._core_bpe.encode_ordinary(" " + " ".join(own)), dtype="<u4")
            cuts = np.flatnonzero(self.blank_first[ids])
            if len(cuts) != len(own):
                self.known.update((w, self._whole(" " + w)) for w in own)
                continue
            raw = ids.tobytes()
            ends = (4 * np.append(cuts[1:], len(ids))).tolist()
            self.known.update((w, raw[a:b]) for w, a, b in zip(own, (4 * cuts).tolist(), ends, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out: list[bytes | None] = [None] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            if _NOT_LATIN.search(text) or any(s in text for s in self.special):
                out[i] = array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
            elif _WIDE_GAP.search(text) or text.endswith(" ") or text.startswith(" "):
                out[i] = self._whole(text)
            else:
                cut.append((i, text.split(" ")))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        unknown = dict.fromkeys(w for _, words in cut for w in words[1:] if w not in known)
        self._learn(list(unknown))
        for i, words in cut:
            out[i] = self._whole(words[0]) + b"".join([known[w] for w in words[1:]])
        return out


@functools.cache
def byte_tokens(path: str) -> ByteTokens:
    """One per Python worker and file."""
    return ByteTokens(path)
