"""Suffix arrays by two-stage sorting, as far as a given depth."""

from __future__ import annotations

import numpy as np


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it. The end of the text is smaller than every byte."""
    out = np.zeros(len(text), dtype=bool)
    changes = np.flatnonzero(text[1:] != text[:-1])  # the end of every run but the last, whose suffixes are larger
    if len(changes):
        rising = text[changes] < text[changes + 1]
        runs = np.diff(np.concatenate(([-1], changes)))
        out[:changes[-1] + 1] = np.repeat(rising, runs)
    return out


#: Suffixes whose beginnings are held at a time while they are sorted, unless more begin with the same two bytes.
HELD = 20_000


def _sorted_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` bytes: dealt out by two bytes, then sorted some buckets at a time."""
    raw = text.tobytes()
    pair = text[at].astype(np.uint16) << 8
    inner = at + 1 < len(text)
    pair[inner] |= text[at[inner] + 1]
    order = np.argsort(pair, kind="stable")
    at, pair = at[order], pair[order]
    cuts = [*(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(at)]
    done, last = 0, 0
    for cut in cuts:
        if cut - done > HELD and last > done:
            at[done:last] = _by_text(raw, at[done:last], depth)
            done = last
        last = cut
    at[done:] = _by_text(raw, at[done:], depth)
    return at


def _by_text(raw: bytes, at: np.ndarray, depth: int) -> np.ndarray:
    keys = [raw[i:i + depth] for i in at.tolist()]
    return at[sorted(range(len(keys)), key=keys.__getitem__)]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of the suffixes in the order of their first `depth` bytes at least.

    The suffixes smaller than their successor are sorted directly. One scan over the buckets of first bytes induces the
    others: a larger suffix stands in its bucket where its successor stands among all, and as that one begins with a
    smaller byte, or with the same one and is larger too, a whole bucket can be taken at once.
    """
    if not len(text):
        return np.zeros(0, dtype=np.int64)
    direct = _sorted_directly(text, np.flatnonzero(smaller_than_next(text)), depth)
    ends = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([len(text) - 1]))
    out: list[np.ndarray] = []
    for byte in range(256):
        part = np.concatenate(induced[byte]) if induced[byte] else np.zeros(0, dtype=np.int64)
        bucket = [part]
        while len(part):  # runs of one byte: each round steps back by one
            part = part[part > 0] - 1
            part = part[text[part] == byte]
            bucket.append(part)
        bucket.append(direct[ends[byte]:ends[byte + 1]])
        own = np.concatenate(bucket)
        out.append(own)
        before = own[own > 0] - 1
        before = before[text[before] > byte]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            heads, starts = np.unique(first[order], return_index=True)
            for head, group in zip(heads.tolist(), np.split(before[order], starts[1:]), strict=True):
                induced[head].append(group)
    return np.concatenate(out)


def repeated_starts(text: np.ndarray, allowed: np.ndarray, length: int) -> np.ndarray:
    """True where an allowed start begins a string of `length` bytes that another allowed start begins too.

    `allowed` holds only starts with that many bytes after them. Neighbours in the suffix array are compared: the
    common prefix of adjacent suffixes decides.
    """
    out = np.zeros(len(text), dtype=bool)
    order = suffix_array(text, length)
    order = order[allowed[order]]
    if len(order) < 2:
        return out
    words = np.ndarray(len(text) - 7, dtype="<u8", buffer=text.tobytes(), strides=(1,))
    left, right = order[:-1], order[1:]
    for step in [*range(0, length - 7, 8), length - 8]:
        same = words[left + step] == words[right + step]
        left, right = left[same], right[same]
    out[left] = True
    out[right] = True
    return out
