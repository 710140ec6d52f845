"""Fingerprints that feel the order of a text: order MinHash over runs of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederlake.llm.common import PIECE, prepare, text_bytes

#: Letters of a k-mer, k-mers of a tuple, tuples of a fingerprint (16 bits of each are kept).
K, TUPLE, SKETCHES = 3, 2, 64
#: Bytes of a letter in a word of at most LONG bytes, and the bytes that decide about a cut of a longer word; bytes of any letter at most.
LETTER, LONG, LONGEST = 4, 32, 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = np.random.default_rng(20).integers(1, 1 << 63, SKETCHES, dtype=np.uint64)
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def _from_heads(begins: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte the head that it belongs to and how far behind it it stands; bytes before the first count to it."""
    inside = np.maximum(np.cumsum(begins) - 1, 0)
    return inside, np.maximum(np.arange(len(begins)) - head[inside], 0)


def letters(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every letter, and the offsets of the texts among them.

    A letter is a word of LETTER bytes or fewer. Words of up to LONG bytes are cut every LETTER bytes. In longer ones, and
    so in texts without blanks, a letter begins where the LETTER bytes before it say so, one place in four on average,
    and after LONGEST bytes without such a place; an edit moves no more than the cuts around it.
    """
    solid = ~_GAP[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[edge] = solid[edge]
    head = np.flatnonzero(begins)
    if not len(head):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(bounds), dtype=np.int64)
    first = int(head[0])
    size = np.add.reduceat(solid[first:].astype(np.int64), head - first)
    inside, depth = _from_heads(begins, head)
    long = size[inside] > LONG
    begins |= solid & ~long & (depth % LETTER == 0)
    at = np.flatnonzero(solid & long & (depth >= LETTER))
    if len(at):
        window = np.zeros(len(at), dtype=np.uint64)
        for back in range(1, LETTER + 1):
            window = window * _A + data[at - back].astype(np.uint64) + np.uint64(1)
        begins[at[_stir(_stir(window)) >> np.uint64(62) == 0]] = True
        inside, depth = _from_heads(begins, np.flatnonzero(begins))
        begins |= solid & long & (depth % LONGEST == 0)
    head = np.flatnonzero(begins)
    inside, depth = _from_heads(begins, head)
    # the bytes of a letter as a number in an odd base; gaps count nothing
    power = np.cumprod(np.full(LONGEST, _A, dtype=np.uint64))
    counted = np.where(solid, (data.astype(np.uint64) + np.uint64(1)) * power[np.minimum(depth, LONGEST - 1)], np.uint64(0))
    number = np.add.reduceat(counted[first:], head - first)
    starts = np.concatenate(([0], np.cumsum(np.bincount(np.searchsorted(bounds[1:], head, side="right"),
                                                        minlength=len(bounds) - 1))))
    return _stir(number), starts


def _kmers(letter: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every K letters of one text, or of all its letters if there are fewer, and the texts' offsets."""
    sizes = np.diff(at)
    counts = np.where(sizes >= K, sizes - K + 1, (sizes > 0).astype(np.int64))
    starts = np.concatenate(([0], np.cumsum(counts)))
    text = np.repeat(np.arange(len(sizes)), counts)
    begin = at[text] + np.arange(starts[-1]) - starts[text]
    out = np.zeros(len(begin), dtype=np.uint64)
    padded = np.append(letter, np.zeros(K, dtype=np.uint64))
    for step in range(K):
        present = step < sizes[text]
        out = np.where(present, _stir(out * _A + padded[begin + step] + np.uint64(step + 1)), out)
    return out, starts


def _numbered(kmer: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each k-mer and of how many equal ones come before it in its text."""
    text = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts))
    key = kmer ^ _stir(text + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return _stir(kmer)
    first = np.concatenate(([0], np.flatnonzero(~same) + 1))
    count = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    number = np.empty(len(key), dtype=np.uint64)
    number[order] = count.astype(np.uint64)
    return _stir(kmer + number * _A)


def fingerprints(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SKETCHES numbers of 16 bits for every text; all zero for one without words.

    For each sketch the TUPLE k-mers with the smallest hashes, numbered by occurrence, are put back into the order of
    the text and hashed together. Equal texts have equal fingerprints.
    """
    out = np.zeros((len(bounds) - 1, SKETCHES), dtype=np.uint16)
    kmer, starts = _kmers(*letters(data, bounds))
    full = np.flatnonzero(np.diff(starts))
    if not len(full):
        return out
    begin = starts[full]
    numbered = _numbered(kmer, starts)
    room = np.uint64(max(24, int(len(kmer)).bit_length()))
    low = (np.uint64(1) << room) - np.uint64(1)
    place = np.arange(len(kmer), dtype=np.uint64)
    none = np.iinfo(np.uint64).max
    several = np.diff(starts)[full] > 1
    padded = np.append(kmer, np.uint64(0))
    for sketch in range(SKETCHES):
        rank = (numbered ^ _SEEDS[sketch]) * _A
        rank ^= rank >> np.uint64(32)
        rank *= _B
        rank = (rank & ~low) | place
        chosen = np.full((len(full), TUPLE), len(kmer), dtype=np.int64)
        for turn in range(TUPLE):
            least = np.minimum.reduceat(rank, begin)
            at = (least & low).astype(np.int64)
            taken = several | (turn == 0)
            chosen[taken, turn] = at[taken]
            rank[at[taken]] = none
        chosen.sort(axis=1)
        mixed = np.full(len(full), np.uint64(sketch + 1), dtype=np.uint64)
        for turn in range(TUPLE):
            mixed = _stir(mixed * _A + padded[chosen[:, turn]])
        out[full, sketch] = (mixed >> np.uint64(48)).astype(np.uint16)
    return out


def _marks(texts: list[str]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    out, first = [np.zeros((0, SKETCHES), dtype=np.uint16)], 0
    while first < len(raw):
        last, size = first, 0
        while last < len(raw) and (last == first or size + len(raw[last]) <= PIECE):
            size += len(raw[last])
            last += 1
        bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw[first:last]]))).astype(np.int64)
        out.append(fingerprints(np.frombuffer(b"".join(raw[first:last]), dtype=np.uint8), bounds))
        first = last
    return np.concatenate(out)


def _hex(marks: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in marks.astype(">u2")]


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(bucket, own, doc_id, text): the rows of `docs` in ranges of falling doc_id, and at the end of each range the
    first row of the next one as a guest (`own` false); the very first row follows the last. NULL ids come last, NULL
    text counts as empty, rows with the same id are ordered by their text."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))).alias("k"))
    ranges = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = rows.select(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges))).first()[0]
    splits = sorted(set(found or []))
    listed = ", ".join(f"bigint('{s}')" for s in splits)
    placed = rows.withColumn("bucket", F.expr(f"size(filter(array({listed}), s -> s >= k))") if splits else F.lit(0))
    heads = placed.groupBy("bucket").agg(F.max("k").alias("k")).collect()  # one number per range
    order = sorted(heads, key=lambda h: h["bucket"])
    if not order:
        return placed.select("bucket", F.lit(True).alias("own"), "doc_id", "text", "k")
    # the first row of each range, for the range before it
    follows = [(order[i]["bucket"], order[(i + 1) % len(order)]["bucket"], order[(i + 1) % len(order)]["k"])
               for i in range(len(order))]
    asked = spark.createDataFrame(follows, "host int, bucket int, k long")
    guests = (
        placed.join(F.broadcast(asked), ["bucket", "k"])  # one row per range
        .groupBy("host").agg(F.min(F.struct("text", "doc_id")).alias("head"))
        .select(F.col("host").alias("bucket"), F.lit(False).alias("own"), "head.doc_id", "head.text",
                F.lit(-(1 << 63)).alias("k"))
    )
    return placed.select("bucket", F.lit(True).alias("own"), "doc_id", "text", "k").unionByName(guests)


def compared(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For every document its fingerprint, that of an edited text, and how like them those and its neighbour are.

    doc_id, n_chars, edited (the text with its last half replaced by the beginning of the next document), fingerprint,
    edited_fingerprint (hex), near_edited, near_next (share of equal sketches). A table of one row is its own next; an
    empty one gives no rows.
    """

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str, bool]] = []
        mark = np.zeros((0, SKETCHES), dtype=np.uint16)

        def emit(ids: list[int | None], texts: list[str], marks: np.ndarray, own: list[bool]) -> Iterator[pa.RecordBatch]:
            at = [i for i in range(len(texts) - 1) if own[i]]
            for first in range(0, len(at), 500):
                some = at[first:first + 500]
                edited = []
                for i in some:
                    half = len(texts[i]) // 2
                    edited.append(texts[i][:len(texts[i]) - half] + texts[i + 1][:half])
                other = _marks(edited)
                mine, after = marks[some], marks[[i + 1 for i in some]]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([ids[i] for i in some], pa.int64()),
                    "n_chars": pa.array([len(texts[i]) for i in some], pa.int64()), "edited": edited,
                    "fingerprint": _hex(mine), "edited_fingerprint": _hex(other),
                    "near_edited": (mine == other).mean(axis=1), "near_next": (mine == after).mean(axis=1)})

        for batch in batches:
            if not batch.num_rows:
                continue
            data, bounds = text_bytes(batch.column(1))
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            ids, own = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            marks = np.concatenate((mark, _marks(texts)))
            yield from emit([h[0] for h in held] + ids, [h[1] for h in held] + texts, marks, [h[2] for h in held] + own)
            held, mark = [(ids[-1], texts[-1], own[-1])], marks[-1:]

    prepare(docs.sparkSession)
    rows = with_next(docs, id_column, text_column)
    order = [F.col("bucket"), F.col("own").desc(), F.col("k").desc(), F.col("text")]
    # a task for every range: hashed, some tasks would get several of them and others none
    tasks = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionById(tasks, "bucket").sortWithinPartitions(*order).select("doc_id", "text", "own")
    return dealt.mapInArrow(
        per_partition, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
                       "near_edited double, near_next double")
