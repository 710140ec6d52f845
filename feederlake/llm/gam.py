"""Quality classifier: a generalised additive model with pairwise interactions over simple text measures.

Shallow trees are boosted feature by feature, round after round, and summed into one lookup table per feature and per
chosen pair of features; a score is the sum of a few table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederlake.llm.common import map_batches, prepare, row_groups, text_bytes, word_pieces

FEATURES = (
    "log_chars", "symbol_share", "bar_share", "upper_share", "digit_share", "shout_share", "stop_share",
    "line_share", "word_length", "short_word_share", "distinct_word_share", "distinct_line_share", "wide_share",
)
_GROUPS = {  # bytes counted for the shares
    "symbol": b"#*$%&<>", "bar": b"|", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)),
    "digit": b"0123456789", "shout": b"!?", "stop": b".,;:", "line": b"\n", "gap": b" \t\n\x0b\x0c\r",
}
_CLASS = np.full(256, len(_GROUPS), dtype=np.uint8)
for _at, _members in enumerate(_GROUPS.values()):
    _CLASS[list(_members)] = _at
_CLASS[ord("\n")] = list(_GROUPS).index("line")


def _sums(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Marked bytes of every row."""
    out = np.zeros(len(bounds) - 1, dtype=np.int64)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = np.add.reduceat(marks, bounds[:-1][full], dtype=np.int64)
    return out


def _word_measures(text: bytes) -> tuple[int, int, int]:
    total, short, seen = 0, 0, set()
    for words in word_pieces(text):
        total += len(words)
        seen.update(words)
        short += sum(len(w) < 4 for w in words)
    return total, short, len(seen)


def measures(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text; all zero for an empty one."""
    rows = [np.zeros((0, len(FEATURES)))]
    for first, last in row_groups(bounds):
        own = data[bounds[first]:bounds[last]]
        at = bounds[first:last + 1] - bounds[first]
        kind = _CLASS[own]
        n = {name: _sums(kind == k, at) for k, name in enumerate(_GROUPS)}
        wide = _sums(own >= 0xC0, at)
        chars = np.maximum(1, _sums((own & 0xC0) != 0x80, at)).astype(float)
        raw = own.tobytes()
        texts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        words = np.array([_word_measures(t) for t in texts], dtype=float)
        lines = np.array([(len(x), len(set(x))) for x in (t.split(b"\n") for t in texts)], dtype=float)
        total = np.maximum(1, words[:, 0])
        gaps = n["gap"] + n["line"]
        block = np.column_stack([
            np.log1p(chars - 1 + (at[1:] > at[:-1])), n["symbol"] / chars, n["bar"] / chars,
            n["upper"] / np.maximum(1, n["upper"] + n["lower"]), n["digit"] / chars, n["shout"] / chars,
            n["stop"] / chars, n["line"] / chars, np.maximum(0, chars - gaps) / total, words[:, 1] / total,
            words[:, 2] / total, lines[:, 1] / lines[:, 0], wide / chars,
        ])
        block[at[1:] == at[:-1]] = 0
        rows.append(block)
    return np.concatenate(rows)


@dataclass
class Gam:
    """Cut points, lookup tables and intercept; a few thousand numbers in all."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, k], side="right")]
        for (a, b), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"),
                           np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def _cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _gain(g: np.ndarray, h: np.ndarray, smooth: float) -> np.ndarray:
    return g * g / (h + smooth)


def _tree(g: np.ndarray, h: np.ndarray, smooth: float, depth: int) -> np.ndarray:
    """Leaf values, bin by bin, of a tree of that depth over sums of gradients and curvatures."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(left_g, left_h, smooth) + _gain(g.sum() - left_g, h.sum() - left_h, smooth)
        cut = int(np.argmax(gain)) + 1
        return np.concatenate([_tree(g[:cut], h[:cut], smooth, depth - 1), _tree(g[cut:], h[cut:], smooth, depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + smooth))


def _quadrants(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, np.ndarray]:
    """The best tree with one cut on each of two features: its gain and its values cell by cell."""
    sg, sh = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    parts, values = [], []
    for s in (sg, sh):
        inner, right, low, whole = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1], s[-1, -1]
        parts.append((inner, right - inner, low - inner, whole - right - low + inner))
    gain = sum(_gain(a, b, smooth) for a, b in zip(*parts, strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = [a[i, j] / (b[i, j] + smooth) for a, b in zip(*parts, strict=True)]
    out = np.empty_like(g)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = values
    return float(gain[i, j] - _gain(g.sum(), h.sum(), smooth)), out


def fit_tables(
    x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.2, bins: int = 32,
    pair_bins: int = 8, pairs: int = 6, smooth: float = 5.0,
) -> Gam:
    """Cyclic boosting on the logistic loss, main effects first, then the pairs that explain most of the rest.

    Without rows the score is 1/2 everywhere; with one class only, a constant.
    """
    width = x.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = Gam(base=float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    model.cuts = [_cut_points(x[:, k], bins) for k in range(width)]
    model.coarse = [_cut_points(x[:, k], pair_bins) for k in range(width)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    place = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.cuts)]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(width):
            g, h = slopes()
            size = len(model.tables[k])
            step = rate * _tree(np.bincount(place[k], g, size), np.bincount(place[k], h, size), smooth, depth=2)
            model.tables[k] += step
            total += step[place[k]]
    rough = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.coarse)]
    sizes = [len(c) + 1 for c in model.coarse]

    def cells(a: int, b: int) -> tuple[float, np.ndarray]:
        g, h = slopes()
        at, shape = rough[a] * sizes[b] + rough[b], (sizes[a], sizes[b])
        return _quadrants(*(np.bincount(at, v, sizes[a] * sizes[b]).reshape(shape) for v in (g, h)), smooth)

    found = sorted(((cells(a, b)[0], a, b) for a in range(width) for b in range(a)), reverse=True)[:pairs]
    model.pairs = {(a, b): np.zeros((sizes[a], sizes[b])) for _, a, b in found}
    for _ in range(pair_rounds):
        for a, b in model.pairs:
            step = rate * cells(a, b)[1]
            model.pairs[a, b] += step
            total += step[rough[a], rough[b]]
    return model


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, id_column: str, max_rows: int, seed: int = 7
) -> DataFrame:
    """(doc_id, label, and the columns of docs as `row`) of at most `max_rows` labelled ids outside the held-out fifth.

    The ids with the smallest hash are taken, so the choice does not depend on the order of the rows. Ids labelled twice
    count once, with the smaller label; a NULL id or label is never taken.
    """
    chosen = (
        labels.select(F.col(id_column).alias("doc_id"), F.col(label).cast("double").alias("label"))
        .where("doc_id IS NOT NULL AND label IS NOT NULL AND crc32(cast(doc_id AS string)) % 5 <> 0")
        .groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows)
    )
    rows = docs.select(F.col(id_column).alias("doc_id"), F.struct("*").alias("row"))
    return rows.join(F.broadcast(chosen), "doc_id")  # at most max_rows rows of two numbers


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label: str = "quality", max_rows: int = 20_000, **settings: float,
) -> Gam:
    """Learn from a bounded sample of labelled documents; only their measures come to the driver."""

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        values = measures(*text_bytes(batch.column(2)))
        yield {"doc_id": batch.column(0), "label": batch.column(1), "x": list(values)}

    prepare(docs.sparkSession)
    rows = training_rows(docs, labels, label, id_column, max_rows).select("doc_id", "label", f"row.{text_column}")
    found = map_batches(rows, per_batch, "doc_id long, label double, x array<double>")
    sample = found.orderBy("doc_id", "x").limit(2 * max_rows).toPandas()  # an id may stand on several rows
    x = np.array(sample["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit_tables(x, (sample["label"].to_numpy() > 0).astype(float), **settings)


def score(docs: DataFrame, model: Gam, text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """(row, score, predicted): each row of `docs` as a struct, its score in 0..1 and 1 where that reaches `threshold`.

    NULL text scores like an empty one. Whatever other columns there are, they travel in `row` and are not looked at.
    """

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        values = model.score(measures(*text_bytes(batch.column(1))))
        yield {"row": batch.column(0), "score": values, "predicted": (values >= threshold).astype(np.int32)}

    prepare(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.col(text_column).alias("text"))
    kept = rows.schema["row"].dataType.simpleString()
    return map_batches(rows, per_batch, f"row {kept}, score double, predicted int")
