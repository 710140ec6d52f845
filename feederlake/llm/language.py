"""Language identification: sparse multinomial logistic regression on TF-IDF weights of hashed character n-grams.

The weights are learnt by follow-the-regularised-leader with an elastic-net penalty, so most of them are exactly zero; a
temperature, fitted on labelled texts that were kept back, turns the scores into probabilities.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feederlake.llm.common import map_batches, prepare, row_groups, text_bytes
from feederlake.session import settle

#: 2 ** BITS buckets of n-grams, and the longest n-gram.
BITS, LONGEST = 16, 4
#: Characters, and parts of texts, that are counted at a time.
PART, PARTS = 1 << 18, 1 << 15
UNKNOWN = "und"
_SPACE = 32
_LOGS = 1 + np.log(np.maximum(1, np.arange(1024)))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@functools.cache
def _kinds() -> np.ndarray:
    """1 for every letter, 2 for every mark that belongs to one, 0 for all other characters."""
    first = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    return (first == "L").astype(np.uint8) + 2 * (first == "M").astype(np.uint8)


def _buckets(codes: np.ndarray, row: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the n-grams of each length. They do not cross rows; a blank alone is none."""
    codes = codes.astype(np.uint64)
    hashes = codes * _A
    for n in range(1, longest + 1):
        if n > 1:
            hashes = hashes[:-1] * _B + codes[n - 1:]
        inside = row[:len(hashes)] == row[n - 1:] if n > 1 else codes != _SPACE
        own = hashes[inside]
        yield row[:len(hashes)][inside], (((own ^ (own >> np.uint64(31))) * _A) >> np.uint64(64 - BITS)).astype(np.uint32)


def _part_counts(parts: list[tuple[int, str]], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of some parts of texts, given with the text's number, and the numbers of those with a letter."""
    kinds = _kinds()
    low = [f" {t.lower()} " for _, t in parts]
    rows = np.array([r for r, _ in parts])
    codes = np.frombuffer("".join(low).encode("utf-32-le"), dtype="<u4")
    part = np.repeat(np.arange(len(low), dtype=np.uint32), [len(t) for t in low])
    kind = kinds[codes]
    lettered = np.unique(rows[part[kind == 1]])
    codes = np.where(kind > 0, codes, _SPACE)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE) | (part[1:] != part[:-1])
    codes, part = codes[keep], part[keep]
    keys = np.sort(np.concatenate([(p << np.uint32(BITS)) | bucket for p, bucket in _buckets(codes, part, longest)]))
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[:len(keys)]
    return rows[keys[heads] >> BITS], keys[heads] & (1 << BITS) - 1, np.diff(heads, append=len(keys)), lettered


def gram_counts(texts: list[str], longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count), sorted by row and bucket, of the n-grams of lowercased texts, and which texts have a letter.

    Whatever is neither a letter nor its mark is a blank; blanks in a row count as one, and there is one at either end. A
    text of over PART characters is counted part by part; n-grams across such a cut are left out.
    """
    lettered = np.zeros(len(texts), dtype=bool)
    parts = [(r, t[at:at + PART]) for r, t in enumerate(texts) for at in range(0, len(t), PART)]
    found: list[tuple[np.ndarray, ...]] = []
    done = 0
    while done < len(parts):
        last, size = done, 0
        while last < len(parts) and last - done < PARTS and (last == done or size + len(parts[last][1]) <= PART):
            size += len(parts[last][1])
            last += 1
        *entries, rows = _part_counts(parts[done:last], longest)
        lettered[rows] = True
        found.append(tuple(c.astype(np.int64) for c in entries))
        done = last
    empty = np.zeros(0, dtype=np.int64)
    row, bucket, count = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (empty, empty, empty)
    if len(parts) > len({r for r, _ in parts}):  # some text has several parts
        keys = row << BITS | bucket
        order = np.argsort(keys, kind="stable")
        keys, heads = np.unique(keys[order], return_index=True)
        row, bucket, count = keys >> BITS, keys & (1 << BITS) - 1, np.add.reduceat(count[order], heads)
    return row, bucket, count, lettered


@dataclass
class Model:
    """Languages, inverse document frequencies, the weights that are not zero, and the temperature."""

    languages: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.ones(1 << BITS))
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0

    def table(self) -> np.ndarray:
        """The weights of each language over all buckets."""
        out = np.zeros((len(self.languages), 1 << BITS))
        out[:, self.buckets] = self.weights.T
        return out


def unit_weights(row: np.ndarray, count: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """(1 + ln tf) * idf of each entry, divided by the length of its row's vector."""
    value = _LOGS[np.minimum(count, len(_LOGS) - 1)] * idf
    many = count >= len(_LOGS)
    value[many] = (1 + np.log(count[many])) * idf[many]
    return value / np.sqrt(np.bincount(row, value * value, minlength=rows))[row]


def softmax(scores: np.ndarray) -> np.ndarray:
    out = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return out / out.sum(axis=-1, keepdims=True)


def fit_weights(
    rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, classes: int, epochs: int = 4, alpha: float = 1.0,
    beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bucket, class) and bias: FTRL-proximal on the softmax loss, one text at a time. The bias has no penalty."""
    size = 1 << BITS
    z, n, w = (np.zeros((size + 1, classes)) for _ in range(3))
    penalty = np.full((size + 1, 1), l1)
    penalty[size] = 0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            bucket, value = rows[i]
            at, x = np.append(bucket, size), np.append(value, 1.0)
            slope = softmax(x @ w[at])
            slope[label[i]] -= 1
            g = x[:, None] * slope
            before = n[at]
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / alpha * w[at]
            n[at] = after
            held = np.abs(z[at]) <= penalty[at]
            w[at] = np.where(held, 0, -(z[at] - np.sign(z[at]) * penalty[at]) / ((beta + np.sqrt(after)) / alpha + l2))
    return w[:size], w[size]


def fit_temperature(scores: np.ndarray, label: np.ndarray, low: float = 0.05, high: float = 20.0) -> float:
    """The temperature with the least loss on texts that the weights have not seen, by golden-section search.

    One text more of every class is assumed on each side, so that texts without an error do not end in certainty.
    """
    if not len(label):
        return 1.0
    classes = scores.shape[1]
    sure = (len(label) + 1) / (len(label) + classes)
    target = np.full(scores.shape, (1 - sure) / max(1, classes - 1))
    target[np.arange(len(label)), label] = sure

    def loss(log_t: float) -> float:
        return float(-(target * np.log(softmax(scores / np.exp(log_t)) + 1e-300)).sum())

    a, b, share = np.log(low), np.log(high), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - share * (b - a), a + share * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(id_column: Column) -> Column:
    """Documents that nothing is learnt from; one without an id is not learnt from either."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _text_rows(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str]]]:
    data, bounds = text_bytes(batch.column(column))
    for first, last in row_groups(bounds):
        raw, at = data[bounds[first]:bounds[last]].tobytes(), (bounds[first:last + 1] - bounds[first]).tolist()
        yield first, last, [raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)]


def document_frequencies(texts: DataFrame, longest: int) -> tuple[np.ndarray, int]:
    """In how many of all the texts each bucket occurs, and the number of texts with a letter."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in batches:
            for _, _, own in _text_rows(batch, 0):
                _, bucket, _, lettered = gram_counts(own, longest)
                seen += np.bincount(bucket, minlength=len(seen))
                total += int(lettered.sum())
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bucket": np.append(at, -1), "n": np.append(seen[at], total)})

    counted = texts.mapInArrow(per_partition, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(1 << BITS), 0
    for bucket, n in counted:  # at most one row for each bucket
        if bucket < 0:
            total = n
        else:
            out[bucket] = n
    return out, total


def chosen_rows(docs: DataFrame, per_language: int, max_rows: int, seed: int) -> DataFrame:
    """(lang, rank, text) of a bounded sample: texts with the smallest hashes, as many of each language as there are.

    At most `per_language` of each and `max_rows` together; copies of a row count once.
    """
    marked = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("mark"))
    keys = marked.select("doc_id", "lang", "mark").distinct()
    own = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "mark", F.lit(seed)), "doc_id", "mark")
    ranked = keys.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= per_language)
    least = ranked.orderBy("rank", F.xxhash64("lang", F.lit(seed)), "lang").limit(max_rows)
    picked = marked.join(F.broadcast(least), ["doc_id", "lang", "mark"])  # at most max_rows rows
    return picked.groupBy("doc_id", "lang", "mark", "rank").agg(F.first("text").alias("text")).select("lang", "rank", "text")


def fit(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
    per_language: int = 500, max_rows: int = 2_000, longest: int = LONGEST, seed: int = 7, **settings: float,
) -> Model:
    """Learn from the texts and languages of documents that are not held out.

    The document frequencies cover all of these; the weights and the temperature come from a sample of at most
    `per_language` texts of each language and `max_rows` in all, every fifth of a language for the temperature. Rows without
    a language, an id or a letter are not learnt from. Without any, the model knows no language.
    """
    prepare(docs.sparkSession)
    free = docs.where(~held_out(F.col(id_column)) & F.col(id_column).isNotNull() & F.col(lang_column).isNotNull()).select(
        F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))
    free = free.where("text IS NOT NULL")
    seen, total = document_frequencies(free.select("text"), longest)
    idf = np.log((1 + total) / (1 + seen)) + 1

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        for first, last, own in _text_rows(batch, 2):
            row, bucket, count, lettered = gram_counts(own, longest)
            ends = np.searchsorted(row, np.arange(len(own) + 1))
            kept = np.flatnonzero(lettered)
            index = pa.array(kept + first)
            yield {"lang": batch.column(0).take(index), "rank": batch.column(1).take(index),
                   "bucket": pa.array([bucket[ends[i]:ends[i + 1]].astype(np.int32) for i in kept], pa.list_(pa.int32())),
                   "count": pa.array([count[ends[i]:ends[i + 1]].astype(np.int32) for i in kept], pa.list_(pa.int32()))}

    sample = map_batches(chosen_rows(free, per_language, max_rows, seed), per_batch,
                         "lang string, rank int, bucket array<int>, count array<int>")
    rows = settle(sample, "sample").orderBy("rank", "lang").limit(max_rows).toArrow()
    of, rank = rows["lang"].to_pylist(), rows["rank"].to_numpy()
    languages = sorted(set(of))
    if not languages:
        return Model()
    vectors, label = [], np.array([languages.index(name) for name in of])
    for bucket, count in zip(rows["bucket"], rows["count"], strict=True):
        bucket, count = (v.values.to_numpy().astype(np.int64) for v in (bucket, count))
        vectors.append((bucket, unit_weights(np.zeros(len(bucket), dtype=int), count, idf[bucket], 1)))
    kept_back = rank % 5 == 0
    learnt = np.flatnonzero(~kept_back)
    weights, bias = fit_weights([vectors[i] for i in learnt], label[learnt], len(languages), seed=seed, **settings)
    back = np.flatnonzero(kept_back)
    scores = np.array([v @ weights[b] + bias for b, v in (vectors[i] for i in back)]).reshape(-1, len(languages))
    used = np.flatnonzero(weights.any(axis=1))
    return Model(languages, idf, used, weights[used], bias, fit_temperature(scores, label[back]))


def predict(docs: DataFrame, model: Model, text_column: str = "text", longest: int = LONGEST) -> DataFrame:
    """(row, lang_pred, score): each row of `docs` as a struct, its most likely language and the probability of that.

    A text that is NULL or has no letter, and any text if no language was learnt, is `und` with the score 0. Of equally
    likely languages the first by name is taken. Other columns travel in `row` and are not looked at.
    """

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for first, last, own in _text_rows(batch, 1):
                row, bucket, count, lettered = gram_counts(own, longest)
                best, score = np.full(len(own), len(names) - 1), np.zeros(len(own))
                if len(row) and model.languages:
                    value = unit_weights(row, count, model.idf[bucket], len(own))
                    sums = [np.bincount(row, value * weights[bucket], minlength=len(own)) for weights in table]
                    share = softmax((np.column_stack(sums) + model.bias) / model.temperature)
                    best, score = share.argmax(axis=1), share.max(axis=1)
                    best[~lettered], score[~lettered] = len(names) - 1, 0
                yield pa.RecordBatch.from_pydict({
                    "row": batch.column(0).slice(first, last - first), "lang_pred": pa.array(names[best], pa.string()),
                    "score": score})

    prepare(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.col(text_column).alias("text"))
    kept = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(per_partition, f"row {kept}, lang_pred string, score double")
