"""Best-fit packing of tokenised documents into sequences, by a configuration linear program over the lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feederlake.llm.byte_tokens import byte_tokens
from feederlake.llm.common import map_batches, prepare, row_groups, text_bytes
from feederlake.session import settle

END = 2
#: Pieces of one length that are numbered together in one task.
NUMBERED_TOGETHER = 50_000
#: Turns of the multiplicative weights at most; after every `LOOK` of them they stop if the plan is within `GAP` of the bound.
TURNS, LOOK, GAP = 1500, 500, 0.0005
#: How fast a price falls as its length gets covered, and the share of a demand that one turn covers.
ETA, STEP = 2.0, 0.5
#: Shares of the fractional solution that are rounded; 0 is plain best-fit, so a plan is never worse than that.
SHARES = (1.0, 0.8, 0.6, 0.4, 0.0)


def pieces(
    docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = 1024,
    end_id: int = END, keep_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the ids of every document, an end id after them, cut if longer
    than `capacity`. Only the first piece of a document may then be shorter. NULL text counts as empty."""

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        coder, end = byte_tokens(vocabulary), end_id.to_bytes(4, "little")
        data, bounds = text_bytes(batch.column(1))
        for first, last in row_groups(bounds):
            raw = data[bounds[first]:bounds[last]].tobytes()
            at = (bounds[first:last + 1] - bounds[first]).tolist()
            coded = coder.encode([raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)])
            rows: list[tuple[int, int, int, int, int]] = []
            kept: list[np.ndarray] = []
            for row, ids in enumerate(coded):
                ids = ids + end
                total = len(ids) // 4
                start, piece = 0, 0
                while start < total:
                    length = (total - start) % capacity or capacity
                    part = ids[4 * start:4 * (start + length)]
                    rows.append((row, piece, start, length, zlib.crc32(part)))
                    if keep_ids:
                        kept.append(np.frombuffer(part, dtype="<i4"))
                    start, piece = start + length, piece + 1
            number = np.array(rows, dtype=np.int64).reshape(-1, 5)
            out = {
                "doc_id": batch.column(0).slice(first, last - first).take(pa.array(number[:, 0])),
                "piece": number[:, 1].astype(np.int32), "start": number[:, 2], "length": number[:, 3],
                "ids_crc32": number[:, 4]}
            yield out | ({"ids": kept} if keep_ids else {})

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return map_batches(rows, per_batch, schema + (", ids array<int>" if keep_ids else ""))


def _price(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration of greatest price, how many of each length, and that price: a knapsack over the rooms.

    `lengths` ascend. A length that nobody has is worth nothing and stands for waste.
    """
    low = int(lengths[0])
    worth = np.zeros(capacity + 1)
    worth[lengths] = prices
    best = np.zeros(capacity + 1)
    taken = np.zeros(capacity + 1, dtype=np.int64)
    for room in range(low, capacity + 1):
        value = best[room - low::-1] + worth[low:room + 1]
        k = int(value.argmax())
        best[room], taken[room] = value[k], k + low
    counts = np.zeros(capacity + 1, dtype=np.int64)
    room = capacity
    while room >= low:
        counts[taken[room]] += 1
        room -= int(taken[room])
    return counts[lengths], float(best[capacity])


@dataclass
class Cover:
    """The averaged configurations (rows of `counts`) and how often each is used, `bound` times all together."""

    times: np.ndarray
    counts: np.ndarray
    #: No solution of the program, whole or fractional, needs fewer sequences.
    bound: float


def solve(lengths: np.ndarray, wanted: np.ndarray, capacity: int, turns: int = TURNS, gap: float = GAP) -> Cover:
    """Fractional solution of the configuration program by multiplicative weights, with a bound from below.

    Every length starts with its size as price. In each turn the knapsack names the configuration of greatest price,
    which is used until half of the smallest demand in it is met; the prices of its lengths fall by exp(-ETA * share of
    the demand met). Prices are kept over all turns, and the configurations are averaged over them. Divided by the
    greatest price of a configuration, the prices solve the dual program, so every turn gives a bound. Ends if the
    average, rounded and filled up, comes within `gap` of the bound, or after `turns`.
    `lengths` ascend and lie in 1 .. `capacity`; `wanted` are at least 1.
    """
    size, demand = lengths / capacity, wanted.astype(float)
    met = np.zeros(len(lengths))
    found: dict[bytes, int] = {}
    counts: list[np.ndarray] = []
    used: list[float] = []
    bound = float(size @ demand)
    for turn in range(1, turns + 1):
        prices = size * np.exp(-ETA * (met - met.min()))
        chosen, price = _price(prices, lengths, capacity)
        bound = max(bound, float(prices @ demand) / price)
        inside = chosen > 0
        step = STEP * float((demand[inside] / chosen[inside]).min())
        met += step * chosen / demand
        at = found.setdefault(chosen.tobytes(), len(counts))
        if at == len(counts):
            counts.append(chosen)
            used.append(0.0)
        used[at] += step
        if turn % LOOK == 0 or turn == turns:
            cover = Cover(np.array(used) * (bound / sum(used)), np.array(counts), bound)
            whole = sum(times for times, _ in rounded(cover, 1.0, lengths, wanted, capacity))
            if whole <= max(np.ceil(bound - 1e-6), (1 + gap) * bound):
                break
    return cover


def best_fit_groups(lengths: np.ndarray, wanted: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Best-fit decreasing over a histogram, equal sequences in one: (how many, counts of each length).

    The tightest sequence that takes a piece is also the tightest for the next of the same length until it is full, so a
    whole group is filled at once. A length splits one group at most: the work grows with the lengths, not the pieces.
    """
    by_room: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(capacity + 1)]
    for k in np.argsort(-lengths):
        size, left = int(lengths[k]), int(wanted[k])
        filled: list[tuple[int, int, np.ndarray]] = []

        def fill(room: int, times: int, counts: np.ndarray) -> None:
            """Put what is left into `times` sequences with this room."""
            nonlocal left
            fit = room // size
            full = min(times, left // fit)
            part = left - full * fit if full < times else 0
            left -= full * fit + part
            for number, taken in ((full, fit), (int(part > 0), part), (times - full - int(part > 0), 0)):
                if number:
                    after = counts.copy()
                    after[k] += taken
                    filled.append((room - taken * size, number, after))

        for room in range(size, capacity + 1):
            while left and by_room[room]:
                fill(room, *by_room[room].pop())
            if not left:
                break
        if left:
            fill(capacity, -(-left // (capacity // size)), np.zeros(len(lengths), dtype=np.int64))
        for room, number, counts in filled:
            by_room[room].append((number, counts))
    return [group for groups in by_room for group in groups]


def best_fit(lengths: np.ndarray, wanted: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Best-fit decreasing over a histogram: counts of each length, sequence by sequence."""
    return [counts for times, counts in best_fit_groups(lengths, wanted, capacity) for _ in range(times)]


@dataclass
class Plan:
    """Where piece number r of a length goes: a few arrays, bounded by the number of lengths and not of pieces."""

    length: np.ndarray
    first: np.ndarray
    per_sequence: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.length * (1 << 44) + self.first, length * (1 << 44) + rank, side="right") - 1
        turn, slot = np.divmod(rank - self.first[at], self.per_sequence[at])
        return self.sequence[at] + turn, self.offset[at] + slot * length


def rounded(cover: Cover, share: float, lengths: np.ndarray, wanted: np.ndarray, capacity: int
            ) -> list[tuple[int, np.ndarray]]:
    """A share of the solution, every use rounded down and never above the demand; the rest is packed best-fit decreasing."""
    left, used = wanted.copy(), []
    for at in np.argsort(-cover.times, kind="stable"):
        counts = cover.counts[at]
        inside = counts > 0
        times = min(int(share * cover.times[at] + 1e-9), int((left[inside] // counts[inside]).min()))
        if times:
            left -= times * counts
            used.append((times, counts))
    return used + best_fit_groups(lengths, left, capacity)


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Solve, round a few shares of the solution; the plan with the fewest sequences counts, of equals the largest share."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    wanted = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    used: list[tuple[int, np.ndarray]] = []
    if len(lengths):
        cover = solve(lengths, wanted, capacity)
        used = min((rounded(cover, share, lengths, wanted, capacity) for share in SHARES), key=lambda u: sum(n for n, _ in u))
    ranks, rows, sequence = np.zeros(len(lengths), dtype=np.int64), [], 0
    for times, counts in used:
        offset = 0
        for k in np.flatnonzero(counts)[::-1]:
            rows.append((lengths[k], ranks[k], counts[k], sequence, offset))
            offset += int(counts[k] * lengths[k])
            ranks[k] += times * counts[k]
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return Plan(*table.T, sequence)


def pack(
    docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = 1024,
    end_id: int = END, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if they are kept).

    Sequences are filled without gaps from offset 0. Only the counts per length, at most `capacity` of them, come to
    the driver; every piece is numbered among those of its length in salted groups and finds its place in the plan.
    Equal rows are packed as often as they stand; an empty table gives no rows; a NULL doc_id is carried along.
    """
    made = settle(pieces(docs, vocabulary, id_column, text_column, capacity, end_id, keep_ids), "pieces")
    counted = {row["length"]: row["count"] for row in made.groupBy("length").count().collect()}
    where = plan(counted, capacity)
    salts = max(1, -(-sum(counted.values()) // NUMBERED_TOGETHER))
    salted = made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").count().select(
        "length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(own) - 1).join(base, ["length", "salt"])

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        names = batch.schema.names
        columns = {name: batch.column(i) for i, name in enumerate(names) if name != "rank"}
        sequence, offset = where.place(batch.column(names.index("length")).to_numpy(),
                                       batch.column(names.index("rank")).to_numpy())
        yield columns | {"sequence_id": sequence, "offset": offset}

    shown = [c for c in made.columns]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema.fields)
    ranked = ranked.select(*shown, (F.col("base") + F.col("nth")).cast("long").alias("rank"))
    return map_batches(ranked, per_batch, f"{types}, sequence_id long, offset long")
