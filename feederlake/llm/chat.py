"""Conversations as training text: one template, encoded once, with a loss mask aligned to the tokens."""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederlake.llm.common import prepare

#: Strings with a meaning in the template; in a text they are written with a backslash after the first character.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<|endoftext|>")
#: Characters of rendered text after which a long conversation goes on in another block, between two turns.
BLOCK = 1 << 20
_INSIDE = re.compile("|".join(f"{re.escape(c[0])}(?P<n{i}>\\\\*){re.escape(c[1:])}" for i, c in enumerate(CONTROLS)))
_MARK = re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    """One more backslash into every control string, with or without backslashes in it already."""
    return _INSIDE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """The text that escape() was given."""
    return _INSIDE.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its escaped text begins and ends in it."""
    body = escape(text)
    if role == "user":
        before, after = "[INST]", "[/INST]"
    elif role == "assistant":
        before, after = "<s>", "</s>"
    else:
        before, after = f"[ROLE]{escape(role)}[/ROLE]", "</s>"
    return before + body + after, len(before), len(before) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns (role, text) of a rendered text."""
    marks = list(_MARK.finditer(formatted))
    at = 0
    while at < len(marks):
        role = {"[INST]": "user", "<s>": "assistant"}.get(marks[at][0])
        if role is None:
            role = unescape(formatted[marks[at].end():marks[at + 1].start()])
            at += 1
        yield role, unescape(formatted[marks[at].end():marks[at + 1].start()])
        at += 2


@functools.cache
def encoder(path: str) -> tokenizers.Tokenizer:
    """The vocabulary with the control strings as tokens of their own, so that no token crosses the end of a text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    out = tokenizers.Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    out.add_special_tokens([tokenizers.AddedToken(c, normalized=False) for c in CONTROLS])
    return out


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for the tokens in one of the spans, both sorted: two binary searches for each span."""
    out = np.zeros(len(starts) + 1, dtype=np.int64)
    edge = np.array(spans, dtype=np.int64).reshape(-1, 2)
    edge = edge[edge[:, 1] > edge[:, 0]]
    np.add.at(out, np.searchsorted(ends, edge[:, 0], side="right"), 1)
    np.add.at(out, np.searchsorted(starts, edge[:, 1], side="left"), -1)
    return np.cumsum(out[:-1]) > 0


@dataclass
class _Block:
    conv: int | None
    number: int
    parts: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    size: int = 0


def formatted(
    turns: DataFrame, vocabulary: str, conv_column: str = "conv_id", turn_column: str = "turn",
    role_column: str = "role", text_column: str = "text", block: int = BLOCK,
) -> DataFrame:
    """Rendered and encoded conversations: conv_id, block, n_turns, formatted, ids, token_start, token_end, loss.

    Turns are ordered by number, then role and text; NULL numbers come first, NULL roles and texts count as empty, and
    the rows with a NULL conv_id are one conversation. token_start and token_end are the characters of each token, loss
    is true for the tokens of assistant texts. A conversation is one row, or several blocks cut between turns when it is
    very long; the rows are streamed, so that no conversation is held whole. Other columns are not read.
    """

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[_Block] = []
        now: _Block | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            texts = ["".join(b.parts) for b in done]
            coded = encoder(vocabulary).encode_batch(texts, add_special_tokens=False)
            offsets = [np.array(c.offsets, dtype=np.int64).reshape(-1, 2) for c in coded]
            masks = [loss_mask(o[:, 0], o[:, 1], b.spans) for o, b in zip(offsets, done, strict=True)]
            yield pa.RecordBatch.from_pydict({
                "conv_id": pa.array([b.conv for b in done], pa.int64()),
                "block": pa.array([b.number for b in done], pa.int64()),
                "n_turns": pa.array([len(b.parts) for b in done], pa.int64()), "formatted": texts,
                "ids": pa.array([c.ids for c in coded], pa.list_(pa.int32())),
                "token_start": pa.array([o[:, 0] for o in offsets], pa.list_(pa.int64())),
                "token_end": pa.array([o[:, 1] for o in offsets], pa.list_(pa.int64())),
                "loss": pa.array(masks, pa.list_(pa.bool_()))})
            done.clear()

        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for conv, role, text in rows:
                if now is None or now.conv != conv or now.size > block:
                    if now is not None:
                        done.append(now)
                        if sum(b.size for b in done) > block or len(done) >= 500:
                            yield from flush()
                    now = _Block(conv, now.number + 1 if now is not None and now.conv == conv else 0)
                part, first, last = render(role or "", text or "")
                if role == "assistant":
                    now.spans.append((now.size + first, now.size + last))
                now.parts.append(part)
                now.size += len(part)
        if now is not None:
            done.append(now)
            yield from flush()

    prepare(turns.sparkSession)
    rows = turns.select(
        F.col(conv_column).cast("long").alias("conv_id"), F.col(turn_column).alias("turn"),
        F.col(role_column).alias("role"), F.col(text_column).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(
        per_partition, "conv_id long, block long, n_turns long, formatted string, ids array<int>, "
                       "token_start array<long>, token_end array<long>, loss array<boolean>")


def masked_text(text: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> Iterator[str]:
    """The characters under the mask, one run of tokens after the other."""
    edge = np.diff(np.concatenate(([0], loss.astype(np.int8), [0])))
    for first, last in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True):
        yield text[starts[first]:ends[last]]


def digests(blocks: DataFrame) -> DataFrame:
    """Read conversations back from what formatted() returned, in its order: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        rows: list[tuple[object, ...]] = []
        state: list | None = None

        def close() -> None:
            conv, turns, digest, chars, loss, size = state
            rows.append((conv, turns, digest.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            names = batch.schema.names
            table = {n: batch.column(names.index(n)) for n in names}
            for i in range(batch.num_rows):
                conv, number, text = (table[n][i].as_py() for n in ("conv_id", "block", "formatted"))
                if state is None or number == 0:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                starts, ends, loss = (table[n][i].values.to_numpy(zero_copy_only=False)
                                      for n in ("token_start", "token_end", "loss"))
                for run in masked_text(text, starts, ends, loss):
                    plain = unescape(run)
                    state[3] += len(plain)
                    state[4].update(plain.encode())
                state[5] += len(text)
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(columns, map(list, zip(*rows, strict=True)), strict=True)),
                                                 schema=schema)
                rows.clear()
        if state is not None:
            close()
            yield pa.RecordBatch.from_pydict(dict(zip(columns, map(list, zip(*rows, strict=True)), strict=True)),
                                             schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    chosen = blocks.select("conv_id", "block", "formatted", "token_start", "token_end", "loss")
    return chosen.mapInArrow(
        per_partition, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                       "formatted_chars long")
