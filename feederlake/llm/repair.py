"""Repair of conversations: the cheapest edits that make the turns `(system? (user assistant)+)?`, and which they are.

The rows of a conversation are streamed twice. From the last to the first, the cheapest cost from each of the four states
of the pattern is carried along, and every row goes on with one byte: the first letter of the best edits from each state,
two bits each. These bytes are written to the shared folder with the rows, so that nothing of a giant conversation
is held in memory. Then, from the first to the last, the bytes are followed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feederlake.llm.common import prepare
from feederlake.session import settle

#: States of the pattern: nothing yet, after system, after user, after assistant. The first and the last may end.
STATES = range(4)
AFTER_INSERT = (2, 2, 3, 2)
ADDED = (None, None, "user", "assistant")
KEEP_TO = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
LETTERS = "DIKR"
KEEP, CHANGE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ENDS = (0, 6, 3, 0)
FAULTS = ("", "blank", "duplicate", "truncated")
_WORD = r"[^\x20\x09-\x0D]"


def step(after: tuple[int, ...], initial: str, fault: str) -> tuple[tuple[int, ...], int]:
    """The costs from each state before a row, given those after it, and the byte with the letters to take.

    Of equal costs the letter that comes first in ASCII is taken; a letter leads to one state only, so the whole string
    of letters is the least one.
    """
    extra = TRUNCATED if fault == "truncated" else 0
    bound = fault in ("blank", "duplicate")
    ways: list[dict[str, int]] = []
    for state in STATES:
        way = {"D": DELETE + after[state]}
        if not bound:
            way["R"] = CHANGE + extra + after[AFTER_INSERT[state]]
            kept = KEEP_TO.get(initial, {}).get(state)
            if kept is not None:
                way["K"] = KEEP + extra + after[kept]
        ways.append(way)
    here = [min(w.values()) for w in ways]
    for state in (2, 3, 2, 0, 1):  # a row may be put in before this one, and another one before that
        here[state] = min(here[state], INSERT + here[AFTER_INSERT[state]])
    byte = 0
    for state in STATES:
        ways[state]["I"] = INSERT + here[AFTER_INSERT[state]]
        letter = min(k for k, cost in ways[state].items() if cost == here[state])
        byte |= LETTERS.index(letter) << 2 * state
    return tuple(here), byte


@dataclass
class Costs:
    """The costs from each state, as carried from row to row; what a row does to them is looked up."""

    now: tuple[int, ...] = ENDS
    known: dict[tuple, tuple[tuple[int, ...], int]] = field(default_factory=dict)

    def take(self, initial: str, fault: str) -> int:
        low = min(self.now)  # only differences matter, and there are few of those
        key = (*(c - low for c in self.now), initial, fault)
        if key not in self.known:
            self.known[key] = step(key[:4], initial, fault)
        self.now, byte = self.known[key]
        return byte


def _as_text(rows: DataFrame, *others: str) -> DataFrame:
    """Numbers that may be NULL as text: pandas would make them floats."""
    return rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), *others)


def _as_numbers(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn") if c in rows.columns})


def faults(text: Column, duplicate: Column) -> Column:
    """The first fault of a row: blank, duplicate, truncated, or an empty string."""
    cut = ~F.coalesce(text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), F.lit(False))
    blank = ~F.coalesce(text.rlike(_WORD), F.lit(False))
    return F.when(blank, "blank").when(duplicate, "duplicate").when(cut, "truncated").otherwise("")


def _with_late(turns: DataFrame) -> DataFrame:
    """The rows with `late`: whether the same role and text stand at a smaller turn of the conversation."""
    own = turns.withColumn("mark", F.md5(F.concat(
        F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    turn = F.coalesce(F.col("turn"), F.lit(-(1 << 63)))
    here = own.where("NOT absent").groupBy("conv_id", "mark").agg(F.min(turn).alias("first"), F.max(turn).alias("last"))
    many = here.where("first < last").select(F.col("conv_id").alias("c"), F.col("mark").alias("m"), "first")
    joined = own.join(many, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m")), "left")
    return joined.withColumn("late", F.coalesce(turn > F.col("first"), F.lit(False))).drop("c", "m", "first")


def _backwards(turns: DataFrame) -> DataFrame:
    """Every row with its place from the end of its conversation (the last has 0), its fault and its byte."""

    def per_partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        costs, conv, place = Costs(), None, -1

        def walk(rows: pd.DataFrame, final: bool) -> Iterator[pd.DataFrame]:
            """A row is a duplicate if the one before it in the conversation, next in the stream, is the same."""
            nonlocal conv, place
            same = np.zeros(len(rows), dtype=bool)
            if len(rows) > 1:
                a, b = rows.iloc[:-1], rows.iloc[1:]
                same[:-1] = ~a["absent"].to_numpy() & ~b["absent"].to_numpy()
                for name in ("conv_id", "turn", "mark"):
                    same[:-1] &= a[name].to_numpy() == b[name].to_numpy()
            done = rows if final else rows.iloc[:-1]
            places, marks, bytes_ = [], [], []
            for c, fault, twin, role, absent in zip(
                    done["conv_id"], done["fault"], same, done["role"], done["absent"], strict=False):
                if place < 0 or c != conv:
                    conv, place, costs.now = c, -1, ENDS
                place += 1
                fault = "duplicate" if twin and fault != "blank" else fault
                bytes_.append(-1 if absent else costs.take(role[:1], fault))
                marks.append(fault)
                places.append(place)
            if len(done):
                yield done[["conv_id", "turn", "role", "text", "absent"]].assign(fault=marks, place=places, byte=bytes_)

        for frame in frames:
            if len(frame):
                rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
                yield from walk(rows, final=False)
                held = rows.iloc[-1:]
        if held is not None:
            yield from walk(held, final=True)

    dealt = turns.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), "absent")
    stream = _as_text(dealt, "role", "text", "absent", "mark", "fault")
    return _as_numbers(stream.mapInPandas(
        per_partition, "conv_id string, turn string, role string, text string, absent boolean, fault string, place long, byte int"))


#: Columns of repaired() as they leave the stream.
EDITS = "conv_id string, step long, edit string, turn string, fault string, old_role string, role string, text string, cost int"


def repaired(
    turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
    text_column: str = "text", absent: Column | None = None,
) -> DataFrame:
    """The edits of every conversation, one row each: conv_id, step, edit, turn, fault, old_role, role, text, cost.

    Turns stand by number (NULL first), then role and text. A row is blank (no word in it), a duplicate (role and text as
    in a row before it) or truncated (it does not end in a full stop, exclamation or question mark); the first of these
    counts. Edits: K keeps a row, R gives it the role user or assistant (3), D deletes it (4; blank rows and duplicates must
    go), I puts in an empty row of user or assistant (3); a truncated row that stays costs 3. The edits are the cheapest
    that leave nothing or rows whose roles begin with s (at most one, first), then u and a in turn; of equally cheap ones
    those whose letters come first. role and text are what stays, NULL after D; old_role is what was there, NULL for I.

    Each conversation, also one without rows, begins with step 0 and an empty edit; then come its edits from step 1 on.
    NULL roles and texts count as one space; the rows without a conv_id are one conversation. Rows where `absent` is true
    only name their conversation. Other columns are not read.
    """
    prepare(turns.sparkSession)
    gone = F.lit(False) if absent is None else absent
    rows = turns.select(
        F.col(conv_column).cast("long").alias("conv_id"), F.col(turn_column).cast("long").alias("turn"),
        *(F.when(~gone, F.coalesce(F.col(c), F.lit(" "))).otherwise("").alias(n)
          for c, n in ((role_column, "role"), (text_column, "text"))), gone.alias("absent"))
    marked = _with_late(settle(rows, "turns"))
    marked = marked.withColumn("fault", faults(F.col("text"), F.col("late")))
    back = settle(_backwards(marked.select("conv_id", "turn", "role", "text", "absent", "mark", "fault")), "backpointers")

    def per_partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in EDITS.split(", ")]
        out: list[tuple] = []
        size, conv, state, number = 0, None, 0, -1

        def put(edit: str, turn: int | None, fault: str, old: str | None, role: str | None, text: str | None, cost: int) -> None:
            nonlocal number
            number += 1
            out.append((conv, number, edit, turn, fault, old, role, text, cost))

        def insert() -> None:
            nonlocal state
            state = AFTER_INSERT[state]
            put("I", None, "", None, ADDED[state], "", INSERT)

        def close() -> None:
            while ENDS[state]:
                insert()

        def frame() -> pd.DataFrame:
            table = pd.DataFrame(out, columns=names)
            out.clear()
            return table

        for rows in frames:
            columns = (rows[c] for c in ("conv_id", "turn", "role", "text", "absent", "fault", "byte"))
            for c, turn, role, text, absent, fault, byte in zip(*columns, strict=True):
                if number < 0 or c != conv:
                    if number >= 0:
                        close()
                    conv, state, number = c, 0, -1
                    put("", None, "", None, None, None, 0)
                if absent:
                    continue
                while (letter := LETTERS[byte >> 2 * state & 3]) == "I":
                    insert()
                extra = TRUNCATED if fault == "truncated" else 0
                if letter == "D":
                    put("D", turn, fault, role, None, None, DELETE)
                elif letter == "K":
                    state = KEEP_TO[role[:1]][state]
                    put("K", turn, fault, role, role, text, KEEP + extra)
                else:
                    state = AFTER_INSERT[state]
                    put("R", turn, fault, role, ADDED[state], text, CHANGE + extra)
                size += len(text)
                if len(out) >= 10_000 or size > 1 << 20:
                    yield frame()
                    size = 0
        if number >= 0:
            close()
        if out:
            yield frame()

    dealt = back.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("place"))
    return _as_numbers(_as_text(dealt, "role", "text", "absent", "fault", "byte").mapInPandas(per_partition, EDITS))


def digests(edits: DataFrame) -> DataFrame:
    """Read the edits of repaired() back, in their order: one row (conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256) for each conversation. Raises ValueError where steps of a conversation are missing."""

    def per_partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: dict | None = None
        out: list[tuple] = []

        def close() -> None:
            low, high, kinds = now["low"], now["high"], now["kinds"]
            out.append((now["conv"], high - low + 1 - now["turns"] if now["turns"] else 0, kinds["blank"], kinds["duplicate"],
                        kinds["truncated"], now["illegal"], now["cost"], now["audit"].decode(), now["sha"].hexdigest()))

        def table() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
            out.clear()
            return frame

        for rows in frames:
            columns = (rows[c] for c in ("conv_id", "step", "edit", "turn", "fault", "old_role", "role", "text", "cost"))
            for conv, number, edit, turn, fault, old, role, text, cost in zip(*columns, strict=True):
                if number == 0:
                    if now is not None:
                        close()
                    now = {"conv": conv, "step": 0, "low": 0, "high": 0, "turns": 0, "illegal": 0, "cost": 0, "audit": bytearray(),
                           "kinds": dict.fromkeys(FAULTS, 0), "sha": hashlib.sha256(), "before": None, "any": False}
                    continue
                if now is None or now["conv"] != conv or now["step"] + 1 != number:
                    raise ValueError(f"the steps of conversation {conv} are not together")
                now["step"] = number
                now["audit"] += edit.encode()
                now["cost"] += int(cost)
                if edit != "I":
                    now["kinds"][fault] += 1
                    pair = (now["before"], old[:1])
                    now["illegal"] += now["before"] is not None and pair not in (("s", "u"), ("u", "a"), ("a", "u"))
                    now["before"] = old[:1]
                    if turn is not None:
                        turn = int(turn)
                        if not now["turns"]:
                            now["low"] = turn
                        if not now["turns"] or turn != now["high"]:
                            now["turns"] += 1
                        now["high"] = turn
                if edit != "D":
                    now["sha"].update(("\n" if now["any"] else "").encode() + f"{role}:{text}".encode())
                    now["any"] = True
            if out:
                yield table()
        if now is not None:
            close()
            yield table()

    schema = ("conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
              "repaired_sha256 string")
    stream = _as_text(edits, "step", "edit", "fault", "old_role", "role", "text", "cost")
    return _as_numbers(stream.mapInPandas(per_partition, schema))
