"""Removal of long byte strings that occur more than once anywhere in a corpus, by suffix arrays.

A string of 200 bytes belongs to the anchor that its own bytes choose: the 64 bytes in it with the smallest hash. Equal
strings have equal anchors at equal distances, so the starts of a document fall into short runs, one per anchor, and
only runs with the same anchor need to be compared. Runs equal as a whole are settled by counting, runs whose anchor
occurs nowhere else are dropped, and what remains, the surroundings of edits and the borders of shared passages, is
compared byte by byte in suffix arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederlake.llm.common import PIECE, map_batches, prepare, row_groups, text_bytes
from feederlake.llm.suffix_array import repeated_starts
from feederlake.session import settle

ANCHOR = 64
#: Bytes of text per suffix array, and windows of one anchor up to which they are compared in one place.
BLOCK = 1 << 19
TOGETHER = 10_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _stir(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` bytes (a power of two), by doubling."""
    now = _stir((data.astype(np.uint64) + np.uint64(1)) * _A)
    step = 1
    while step < width:
        now = _stir(now[:-step] * _A + now[step:]) if len(now) > step else now[:0]
        step *= 2
    return now


def _smallest(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of every `width` hashes; of equal ones the last."""
    low = np.uint64((1 << 22) - 1)
    now = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))
    step = 1
    while 2 * step <= width:
        now = np.minimum(now[:-step], now[step:])
        step *= 2
    rest = width - step
    if rest:
        now = np.minimum(now[:-rest], now[rest:])
    return (low - (now & low)).astype(np.int64)


def owned_runs(data: np.ndarray, bounds: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The runs of starts with one anchor: text (row), first start in it, more starts, hashes of anchor and window."""
    found: list[tuple[np.ndarray, ...]] = []
    for first, last in row_groups(bounds):
        begin, end = int(bounds[first]), int(bounds[last])
        # a text longer than a piece stands alone here and is cut into pieces that share length - 1 bytes
        for at in range(begin, max(begin + 1, end - length + 1), PIECE) if last - first == 1 else (begin,):
            own = data[at:min(end, at + PIECE + length - 1)] if last - first == 1 else data[at:end]
            if len(own) < length:
                continue
            hashes = window_hashes(own, ANCHOR)
            anchor = _smallest(hashes, length - ANCHOR + 1)
            start = np.arange(len(anchor))
            row = np.searchsorted(bounds[first + 1:last + 1], at + start, side="right") + first
            inside = at + start + length <= bounds[row + 1]
            start, anchor, row = start[inside], anchor[inside], row[inside]
            if not len(start):
                continue
            cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])) + 1
            p0 = start[np.concatenate(([0], cut))]
            p1 = start[np.concatenate((cut - 1, [len(start) - 1]))]
            chosen = np.concatenate(([0], cut))
            last_hash = p1 + length - ANCHOR
            whole = hashes[p0]
            for step in range(1, (2 * length - 2 * ANCHOR) // ANCHOR + 2):
                whole = _stir(whole * _A + hashes[np.minimum(p0 + step * ANCHOR, last_hash)])
            whole = _stir(whole + (p1 - p0).astype(np.uint64) * _A + (anchor[chosen] - p0).astype(np.uint64) * _B)
            found.append((row[chosen], p0 + at - bounds[row[chosen]], p1 - p0, hashes[anchor[chosen]], whole))
    empty = np.zeros(0, dtype=np.int64)
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [empty] * 5
    return dict(zip(("row", "start", "more", "anchor", "window"), columns, strict=True))


def _runs(rows: DataFrame, length: int) -> DataFrame:
    """All runs (k1, k2, place, anchor, window). Within a batch equal runs meet at once: all but one of them are known to
    be repeated (place % 4 = 3) and get an anchor of their own, and the one that goes on says so (1).
    place = start * 1024 + more starts * 4 + repeated."""

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        runs = owned_runs(*text_bytes(batch.column(2)), length)
        order = np.lexsort((runs["window"], runs["anchor"]))
        same = ((runs["anchor"][order][1:] == runs["anchor"][order][:-1])
                & (runs["window"][order][1:] == runs["window"][order][:-1]))
        later, twice = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=np.int64)
        later[order[1:]] = same
        twice[order[:-1]] |= same
        twice[later] = 3
        row = pa.array(runs["row"])
        k1, k2, anchor = batch.column(0).take(row), batch.column(1).take(row), runs["anchor"].copy()
        alone = k1.to_numpy().view(np.uint64) * _A + k2.to_numpy().view(np.uint64) * _B + runs["start"].astype(np.uint64)
        anchor[later] = _stir(_stir(alone) * _A)[later]
        yield {"k1": k1, "k2": k2, "place": (runs["start"] << 10) + (runs["more"] << 2) + twice,
               "anchor": anchor.view(np.int64), "window": runs["window"].view(np.int64)}

    return map_batches(rows, per_batch, "k1 long, k2 long, place long, anchor long, window long")


def _compared(runs: DataFrame) -> DataFrame:
    """Runs that are repeated as a whole (place % 4 = 1), must be compared (2), or both, as one copy of them must (3).

    The runs of an anchor stand next to each other, sorted by window; one row at a time is carried along. Those known to be
    repeated pass through.
    """

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("k1", "k2", "place", "anchor", "window")
        held = [np.zeros(0, dtype=np.int64)] * 5
        met_anchor = met_window = False  # whether the held row agrees with the one before it

        def decide(columns: list[np.ndarray], final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal met_anchor, met_window
            anchor, window = columns[3], columns[4]
            near = anchor[1:] == anchor[:-1]
            equal = near & (window[1:] == window[:-1])
            near_before, equal_before = np.append(met_anchor, near), np.append(met_window, equal)
            near_after, equal_after = np.append(near, False), np.append(equal, False)
            whole = equal_before | equal_after | (columns[2] & 1 > 0)
            border = (near_before & ~equal_before) | (near_after & ~equal_after)
            kind = whole * 1 + border * 2
            keep = np.flatnonzero(kind[:len(kind) - (not final)])
            met_anchor, met_window = bool(near_before[-1]), bool(equal_before[-1])
            place = (columns[2][keep] & ~3) | kind[keep]
            yield pa.RecordBatch.from_pydict(
                {"k1": columns[0][keep], "k2": columns[1][keep], "place": place, "anchor": anchor[keep]})

        for batch in batches:
            if batch.num_rows:
                own = [batch.column(batch.schema.names.index(n)).to_numpy() for n in names]
                columns = [np.concatenate(pair) for pair in zip(held, own, strict=True)]
                yield from decide(columns, final=False)
                held = [c[-1:] for c in columns]
        if len(held[0]):
            yield from decide(held, final=True)

    dealt = runs.repartition("anchor").sortWithinPartitions("anchor", "window")
    return dealt.mapInArrow(per_partition, "k1 long, k2 long, place long, anchor long")


def _crowded(marks: DataFrame, together: int) -> DataFrame:
    """The anchors with very many windows to be compared."""
    return marks.where("place & 2 = 2").groupBy("anchor").count().where(F.col("count") > together).select("anchor")


def _pieces(rows: DataFrame, marks: DataFrame, crowded: DataFrame, length: int) -> DataFrame:
    """What the runs to be compared are compared by: (route, h2, k1, k2, start, more, known, bytes).

    The text of a run goes by its anchor. For crowded anchors every start sends a hash of 128 bits of its string in place
    of the string, in route and h2 (NULL otherwise). The text is shuffled once for both; the lists of marks have no
    bound, so they are not broadcast.
    """

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        data, bounds = text_bytes(batch.column(2))
        raw = data.tobytes()
        lists = batch.column(3)
        flat = lists.flatten()
        place, anchor, crowd = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        for chosen in (np.flatnonzero(~crowd), np.flatnonzero(crowd)):
            hashed = len(chosen) and crowd[chosen[0]]
            sizes = np.cumsum((place[chosen] >> 2 & 255) + 1) if hashed else np.arange(1, len(chosen) + 1)
            done = 0
            while done < len(chosen):  # about 20,000 rows at a time
                last = max(done + 1, int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + 20_000)))
                at = chosen[done:last]
                done = last
                own, start, more, known = row[at], place[at] >> 10, place[at] >> 2 & 255, (place[at] & 1) > 0
                if hashed:
                    steps = more + 1
                    step = np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps)
                    start, own, known = np.repeat(start, steps) + step, np.repeat(own, steps), np.repeat(known, steps)
                    digests = b"".join(hashlib.blake2b(raw[a:a + length], digest_size=16).digest()
                                       for a in (bounds[own] + start).tolist())
                    halves = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
                    route, h2 = np.ascontiguousarray(halves[:, 0]), pa.array(np.ascontiguousarray(halves[:, 1]))
                    more, texts = np.zeros(len(own), dtype=np.int64), pa.nulls(len(own), pa.binary())
                else:
                    begin = bounds[own] + start
                    texts = pa.array([raw[a:b] for a, b in zip(begin.tolist(), (begin + more + length).tolist(), strict=True)],
                                     type=pa.binary())
                    route, h2 = anchor[at], pa.nulls(len(own), pa.int64())
                index = pa.array(own)
                yield {"route": route, "h2": h2, "k1": batch.column(0).take(index), "k2": batch.column(1).take(index),
                       "start": start, "more": more, "known": known, "bytes": texts}

    asked = marks.where("place & 2 = 2").join(crowded.withColumn("crowd", F.lit(True)), "anchor", "left")
    per_text = asked.groupBy("k1", "k2").agg(F.collect_list(
        F.struct("place", "anchor", F.coalesce("crowd", F.lit(False)).alias("crowd"))).alias("marks"))
    marked = rows.join(per_text.hint("merge"), ["k1", "k2"]).select("k1", "k2", "text", "marks")
    return map_batches(
        marked, per_batch,
        "route long, h2 long, k1 long, k2 long, start long, more long, known boolean, bytes binary")


def _counted(starts: DataFrame, length: int) -> DataFrame:
    """Spans (k1, k2, first, last) of the repeated strings of crowded anchors.

    Equal hashes are counted before the shuffle, and all starts of those counted twice or more are found by a join, so
    no task holds the copies of a string.
    """
    twice = starts.groupBy("route", "h2").agg(F.count("*").alias("n")).where("n > 1")
    return starts.where("NOT known").join(twice, ["route", "h2"], "left_semi").select(
        "k1", "k2", F.col("start").alias("first"), (F.col("start") + length).alias("last"))


def _settled(windows: DataFrame, length: int, block: int) -> DataFrame:
    """Spans (k1, k2, first, last) of bytes covered by repeated strings, from suffix arrays over the windows by route."""

    def compare(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        texts = [b.as_buffer() for b in table["bytes"]]
        sizes = np.array([b.size for b in texts], dtype=np.int64)
        text = np.frombuffer(b"\xff".join([*texts, b""]), dtype=np.uint8)  # no byte of a text
        begin = np.cumsum(sizes + 1) - sizes - 1
        more = table["more"].to_numpy()
        allowed = np.zeros(len(text) + 1, dtype=np.int8)
        np.add.at(allowed, begin, 1)
        np.add.at(allowed, begin + more + 1, -1)
        allowed = np.cumsum(allowed[:-1], dtype=np.int8) > 0
        hit = repeated_starts(text, allowed, length)
        edges = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
        row = np.searchsorted(begin, first, side="right") - 1
        fresh = ~table["known"].to_numpy()[row]
        row, first, last = row[fresh], first[fresh], last[fresh]
        shift = table["start"].to_numpy()[row] - begin[row]
        return pa.RecordBatch.from_pydict({
            "k1": table["k1"].to_numpy()[row], "k2": table["k2"].to_numpy()[row],
            "first": first + shift, "last": last + shift + length})

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += batch.nbytes
            if size < block:
                continue
            table = pa.concat_tables(held)
            route = table["route"].to_numpy()
            cuts = np.flatnonzero(route[1:] != route[:-1]) + 1  # whole routes only; the last may go on
            volume = np.concatenate(([0], np.cumsum(np.diff(_offsets(table["bytes"])))))
            done = 0
            for k, cut in enumerate(cuts.tolist()):
                if k + 1 == len(cuts) or volume[cuts[k + 1]] - volume[done] > block:
                    yield compare(table.slice(done, cut - done))
                    done = cut
            held = [table.slice(done)]
            size = int(volume[-1] - volume[done])
            if size >= block:  # one route fills the block: wait for its end
                size = 0
        if held:
            yield compare(pa.concat_tables(held))

    dealt = windows.repartition("route").sortWithinPartitions("route")
    return dealt.mapInArrow(per_partition, "k1 long, k2 long, first long, last long")


def _offsets(column: pa.ChunkedArray) -> np.ndarray:
    return text_bytes(column.combine_chunks() if column.num_chunks != 1 else column.chunk(0))[1]


def without_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 200, together: int = TOGETHER,
    block: int = BLOCK, as_text: bool = False,
) -> DataFrame:
    """(row, kept, n_bytes, n_removed, n_spans): each row of `docs` as a struct and the bytes that stay of its text.

    A byte goes if a string of `length` bytes that covers it starts anywhere else too, in this text or another; what is
    left is not looked at again. NULL counts as empty; texts shorter than `length` stay whole. Equal rows are copies of
    each other, so nothing stays of them if they are long enough. A cut may fall inside a character, so kept is binary;
    as_text makes it a string, without what is left of such characters. Other columns travel in `row`.
    """
    if not ANCHOR < length <= 255 + ANCHOR:
        raise ValueError(f"length must be over {ANCHOR} and at most {255 + ANCHOR}")
    prepare(docs.sparkSession, batch_mb=16)
    named = docs.select(
        F.struct("*").alias("row"), F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = named.selectExpr("coalesce(doc_id, -9223372036854775808) AS k1", "xxhash64(text) AS k2", "text", "row")
    plain = rows.select("k1", "k2", "text")
    marks = settle(_compared(_runs(plain, length)), "marks")
    crowded = settle(_crowded(marks, together), "crowded")
    pieces = settle(_pieces(plain, marks, crowded, length), "pieces")
    compared = _settled(pieces.where("h2 IS NULL"), length, block).unionByName(
        _counted(pieces.where("h2 IS NOT NULL"), length))
    end = F.expr(f"shiftright(place, 10) + (shiftright(place, 2) & 255) + {length}")
    span = ["k1", "k2", F.expr("shiftright(place, 10)").alias("first"), end.alias("last")]
    spans = (
        compared.unionByName(marks.where("place & 1 = 1").select(*span))
        .groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    )

    def cut(data: np.ndarray, bounds: np.ndarray, lists: pa.ListArray) -> dict[str, object]:
        gone = np.zeros(len(data) + 1, dtype=np.int32)
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy())
        np.add.at(gone, bounds[row] + flat.field(0).to_numpy(zero_copy_only=False), 1)
        np.add.at(gone, bounds[row] + flat.field(1).to_numpy(zero_copy_only=False), -1)
        hit = np.cumsum(gone[:-1], dtype=np.int32) > 0
        begins = hit.copy()
        begins[1:] &= ~hit[:-1]
        full = bounds[:-1][bounds[:-1] < bounds[1:]]
        begins[full] = hit[full]
        removed, counts = (np.diff(np.searchsorted(np.flatnonzero(m), bounds)) for m in (hit, begins))
        left = data[~hit].tobytes()
        ends = np.concatenate(([0], np.cumsum(np.diff(bounds) - removed))).tolist()
        kept = [left[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return {"kept": pa.array([k.decode(errors="ignore") for k in kept] if as_text else kept, type=kept_type),
                "n_bytes": np.diff(bounds), "n_removed": removed, "n_spans": counts}

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        data, bounds = text_bytes(pc.struct_field(batch.column(0), [text_column]))
        for first, last in row_groups(bounds):
            yield {"row": batch.column(0).slice(first, last - first)} | cut(
                data[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first],
                batch.column(1).slice(first, last - first))

    kept_type = pa.string() if as_text else pa.binary()
    joined = rows.select("k1", "k2", "row").join(spans, ["k1", "k2"], "left").select("row", "spans")
    kind = f"{joined.schema['row'].dataType.simpleString()}, kept {'string' if as_text else 'binary'}"
    return map_batches(joined, per_batch, f"row {kind}, n_bytes long, n_removed long, n_spans long")
