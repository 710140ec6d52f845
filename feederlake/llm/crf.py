"""Quality rules: a linear-chain conditional random field marks every line as content or boilerplate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederlake.llm.common import map_batches, prepare, row_groups, text_bytes, word_pieces
from feederlake.llm.gam import training_rows

_GAP, _SYMBOL, _BAR, _UPPER, _LOWER, _DIGIT, _SHOUT, _STOP = range(1, 9)
_KIND = np.zeros(256, dtype=np.uint8)
for _code, _members in (
    (_GAP, b" \t\n\x0b\x0c\r"), (_SYMBOL, b"#*$%&<>"), (_BAR, b"|"), (_UPPER, bytes(range(65, 91))),
    (_LOWER, bytes(range(97, 123))), (_DIGIT, b"0123456789"), (_SHOUT, b"!?"), (_STOP, b".,;:"),
):
    _KIND[list(_members)] = _code
#: Limits at which a share of a line counts as one more sign.
_SHARES = {"symbol": (0.0, 0.02, 0.1), "bar": (0.0, 0.03), "upper": (0.3, 0.7), "digit": (0.05, 0.3),
           "shout": (0.01, 0.05), "stop": (0.0, 0.03, 0.1)}
SIGNS = (*(f"{name}>{limit}" for name, limits in _SHARES.items() for limit in limits),
         "repeated", "blank", "one word", "under 4 words", "over 30 words", "long words", "ends a sentence", "any")


@dataclass
class Lines:
    """The lines of some texts: signs, words, and the rows [at[i], at[i + 1]) of text i."""

    signs: np.ndarray
    words: np.ndarray
    dups: np.ndarray
    at: np.ndarray


def read_lines(data: np.ndarray, bounds: np.ndarray) -> Lines:
    """Split every text at newlines; a text has one line at least, an empty one too."""
    breaks = np.flatnonzero(data == 10)
    per_text = np.searchsorted(breaks, bounds[1:]) - np.searchsorted(breaks, bounds[:-1])
    at = np.concatenate(([0], np.cumsum(per_text + 1)))
    starts = np.sort(np.concatenate((bounds[:-1], breaks + 1)), kind="stable")
    ends = np.sort(np.concatenate((breaks, bounds[1:])), kind="stable")
    kind = _KIND[data]
    full = ends > starts

    def total(marks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), dtype=np.int64)
        if full.any():  # the gaps between lines are cut off by counting up to every second border
            borders = np.column_stack((starts[full], ends[full])).ravel()
            padded = np.append(marks, 0)
            out[full] = np.add.reduceat(padded, borders, dtype=np.int64)[::2]
        return out

    n = {name: total(kind == code) for name, code in (
        ("gap", _GAP), ("symbol", _SYMBOL), ("bar", _BAR), ("upper", _UPPER), ("lower", _LOWER), ("digit", _DIGIT),
        ("shout", _SHOUT), ("stop", _STOP))}
    begins = kind != _GAP
    begins[1:] &= kind[:-1] == _GAP
    begins[bounds[:-1][bounds[:-1] < bounds[1:]]] |= kind[bounds[:-1][bounds[:-1] < bounds[1:]]] != _GAP
    words = total(begins)
    length = np.maximum(1, ends - starts)
    raw = data.tobytes()
    dups = np.zeros(len(starts), dtype=bool)
    for i in np.flatnonzero(per_text):
        seen: set[bytes] = set()
        for k in range(at[i], at[i + 1]):
            if words[k]:
                line = raw[starts[k]:ends[k]]
                dups[k] = line in seen
                seen.add(line)
    base = {"upper": np.maximum(1, n["upper"] + n["lower"])}
    shares = [n[name] / base.get(name, length) > limit for name, limits in _SHARES.items() for limit in limits]
    last = np.zeros(len(starts), dtype=np.uint8)
    last[full] = data[ends[full] - 1]
    signs = np.column_stack([
        *shares, dups, words == 0, words == 1, (words > 1) & (words < 4), words > 30,
        length - n["gap"] > 9 * np.maximum(1, words), np.isin(last, np.frombuffer(b".!?:", np.uint8)),
        np.ones(len(starts), dtype=bool),
    ])
    return Lines(signs, words, dups, at)


@dataclass
class Crf:
    """Weights of the signs for boilerplate (against content) and of each step from one label to the next."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(SIGNS)))
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def emissions(self, signs: np.ndarray) -> np.ndarray:
        return np.column_stack((np.zeros(len(signs)), signs @ self.weights))


def _fronts(at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Line t of every text that has one, for all t; the texts come longest first."""
    counts = np.diff(at)
    order = np.argsort(-counts, kind="stable")
    falling = -counts[order]
    for t in range(int(counts.max(initial=0))):
        yield t, order[:np.searchsorted(falling, -t, side="left")]


def viterbi(emissions: np.ndarray, steps: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The best labels (0 content, 1 boilerplate) of every chain; content where two paths tie."""
    best = np.zeros((len(at) - 1, 2))
    back = np.zeros((len(emissions), 2), dtype=np.int8)
    fronts = list(_fronts(at))
    for t, rows in fronts:
        line = at[rows] + t
        if t:
            paths = best[rows][:, :, None] + steps[None]
            back[line] = paths.argmax(axis=1)
            best[rows] = paths.max(axis=1)
        best[rows] += emissions[line]
    labels = np.zeros(len(emissions), dtype=np.int8)
    counts = np.diff(at)
    for t, rows in reversed(fronts):
        line = at[rows] + t
        ended = counts[rows] == t + 1
        after = np.minimum(line + 1, len(labels) - 1)
        labels[line] = np.where(ended, best[rows].argmax(axis=1), back[after, labels[after]])
    return labels


def _expected(emissions: np.ndarray, steps: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: chance of boilerplate for every line, and expected counts of the four steps."""
    forward, backward = np.zeros_like(emissions), np.zeros_like(emissions)
    counts = np.diff(at)
    fronts = list(_fronts(at))
    for t, rows in fronts:
        line = at[rows] + t
        forward[line] = emissions[line]
        if t:
            forward[line] += np.logaddexp.reduce(forward[line - 1][:, :, None] + steps[None], axis=1)
    pairs = np.zeros((2, 2))
    for t, rows in reversed(fronts):
        line = (at[rows] + t)[counts[rows] > t + 1]
        if len(line):
            ahead = emissions[line + 1] + backward[line + 1]
            both = steps[None] + ahead[:, None, :]
            backward[line] = np.logaddexp.reduce(both, axis=2)
            joint = forward[line][:, :, None] + both
            joint -= np.logaddexp.reduce(joint.reshape(len(line), 4), axis=1)[:, None, None]
            pairs += np.exp(joint).sum(axis=0)
    whole = forward + backward
    return np.exp(whole[:, 1] - np.logaddexp(whole[:, 0], whole[:, 1])), pairs


def fit_chain(lines: Lines, junk: np.ndarray, rounds: int = 60, rate: float = 0.3, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood by gradient steps. A text's label stands for all of its lines; no rows give zero weights."""
    model = Crf()
    if not len(junk):
        return model
    truth = np.repeat(junk.astype(float), np.diff(lines.at))
    inner = np.ones(len(truth), dtype=bool)
    inner[lines.at[1:] - 1] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[inner].astype(int), truth[inner].astype(int)), 1)
    x = lines.signs.astype(float)
    theta, mean, spread = np.zeros(len(SIGNS) + 4), np.zeros(len(SIGNS) + 4), np.zeros(len(SIGNS) + 4)
    for turn in range(1, rounds + 1):
        chance, pairs = _expected(model.emissions(lines.signs), model.steps, lines.at)
        slope = np.concatenate((x.T @ (truth - chance), (seen - pairs).ravel())) / len(truth) - ridge * theta
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        theta = theta + rate * (mean / (1 - 0.9**turn)) / (np.sqrt(spread / (1 - 0.99**turn)) + 1e-8)
        model = Crf(theta[:len(SIGNS)], theta[len(SIGNS):].reshape(2, 2))
    return model


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label: str = "quality", max_rows: int = 1_000,
) -> Crf:
    """Learn from the lines of at most `max_rows` labelled documents: label 0 means boilerplate, more means content."""

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        data, bounds = text_bytes(batch.column(2))
        for first, last in row_groups(bounds):
            lines = read_lines(data[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first])
            yield {
                "doc_id": batch.column(0).slice(first, last - first), "label": batch.column(1).slice(first, last - first),
                "signs": [np.packbits(lines.signs[a:b], axis=1).tobytes()
                          for a, b in zip(lines.at[:-1], lines.at[1:], strict=True)]}

    prepare(docs.sparkSession)
    rows = training_rows(docs, labels, label, id_column, max_rows).select("doc_id", "label", f"row.{text_column}")
    found = map_batches(rows, per_batch, "doc_id long, label double, signs binary")
    sample = found.orderBy("doc_id", "signs").limit(2 * max_rows).toPandas()
    width = (len(SIGNS) + 7) // 8
    parts = [np.frombuffer(bytes(s), np.uint8).reshape(-1, width) for s in sample["signs"]]
    packed = np.concatenate([np.zeros((0, width), np.uint8), *parts])
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    signs = np.unpackbits(packed, axis=1)[:, :len(SIGNS)].astype(bool)
    none = np.zeros(len(signs))
    return fit_chain(Lines(signs, none, none, at), sample["label"].to_numpy() <= 0)


def repeated_words(text: bytes) -> tuple[int, int]:
    """Words of a text, and those that lie in a window of three words found twice or more."""
    codes: dict[bytes, int] = {}
    parts = [np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
             for words in word_pieces(text)]
    word = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if len(word) < 4:
        return len(word), 0
    size = len(codes)
    pair = word[:-1] * size + word[1:]
    if size >= 1 << 20:  # three codes would not fit one number
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * size + word[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    window = np.zeros(len(key), dtype=bool)
    window[order[1:]] = same
    window[order[:-1]] |= same
    inside = np.zeros(len(word), dtype=bool)
    for shift in range(3):
        inside[shift:len(word) - 2 + shift] |= window
    return len(word), int(inside.sum())


_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def judge(data: np.ndarray, bounds: np.ndarray, model: Crf, least_content: float) -> dict[str, np.ndarray]:
    """The counts and the verdict for some texts."""
    lines = read_lines(data, bounds)
    labels = viterbi(model.emissions(lines.signs), model.steps, lines.at)
    per_text = lambda v: np.add.reduceat(v.astype(np.int64), lines.at[:-1]) if len(v) else np.zeros(0, np.int64)
    raw = data.tobytes()
    counted = [repeated_words(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    n_words, n_repeat = np.array(counted, dtype=np.int64).reshape(-1, 2).T

    def total(marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(marks, dtype=np.int32)))
        return (sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.int64)

    content = per_text(np.where(labels == 0, lines.words, 0))
    share = np.where(n_words > 0, content / np.maximum(1, n_words), 0.0)
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    return {
        "n_words": n_words, "word_chars": total(((data & 0xC0) != 0x80) & (_KIND[data] != _GAP)),
        "n_symbols": total(_SYMBOLS[data]), "n_dup_lines": per_text(lines.dups), "n_repeat_words": n_repeat,
        "base_failed": failed, "n_lines": np.diff(lines.at), "n_boilerplate_lines": per_text(labels),
        "content_share": share, "kept": ~failed & (share >= least_content)}


COUNTS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "n_lines long, n_boilerplate_lines long, content_share double, kept boolean")


def judged(docs: DataFrame, model: Crf, text_column: str = "text", least_content: float = 0.5) -> DataFrame:
    """Each row of `docs` as a struct `row`, with its counts, the share of its words in content lines, and `kept`.

    kept: the base rules pass and that share reaches `least_content`. NULL and empty texts have no words and fail the
    base. Other columns travel in `row`, whatever their names.
    """

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        data, bounds = text_bytes(batch.column(1))
        for first, last in row_groups(bounds):
            own = judge(data[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first], model, least_content)
            yield {"row": batch.column(0).slice(first, last - first), **own}

    prepare(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.col(text_column).alias("text"))
    return map_batches(rows, per_batch, f"row {rows.schema['row'].dataType.simpleString()}, {COUNTS}")
