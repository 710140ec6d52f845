import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from feederlake.llm import crf, gam
from feederlake.llm.common import text_bytes


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] >= 2 for k in (i, i + 1, i + 2)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside),
            len(words) < 50 or 100 * len(inside) > 50 * len(words))


def test_base_counts(odd_docs, odd_rows):
    got = crf.judged(odd_docs, crf.Crf()).select("row.doc_id", "row.text", "*").collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(r.text)
        assert r.kept == (not r.base_failed)  # zero weights: all lines are content


def test_repeated_words_with_many_words():
    words = [str(i) for i in range((1 << 20) + 5)] + ["1", "2", "3", "4"]
    assert crf.repeated_words(" ".join(words).encode()) == (len(words), 8)


def test_viterbi_finds_the_best_path():
    own = np.random.default_rng(4)
    at = np.array([0, 1, 4, 4 + 6, 10 + 3])
    emissions, steps = own.normal(size=(13, 2)), own.normal(size=(2, 2))
    got = crf.viterbi(emissions, steps, at)
    for a, b in itertools.pairwise(at):
        def value(path, a=a):
            return sum(emissions[a + i, y] for i, y in enumerate(path)) + sum(steps[x, y] for x, y in itertools.pairwise(path))
        assert tuple(got[a:b]) == max(itertools.product((0, 1), repeat=b - a), key=value)
    chance, _ = crf._expected(emissions, steps, at)
    weights = {p: np.exp(sum(emissions[1 + i, y] for i, y in enumerate(p)) + steps[p[0], p[1]] + steps[p[1], p[2]])
               for p in itertools.product((0, 1), repeat=3)}
    for i in range(3):
        assert np.isclose(chance[1 + i], sum(w for p, w in weights.items() if p[i]) / sum(weights.values()))


def test_rules_agree_with_labels(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    got = crf.judged(docs, crf.fit(docs, labels)).where("not base_failed").selectExpr("row.doc_id", "kept").join(
        labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in got}
    assert share[1] > 0.97 and share[0] < 0.3


def test_quality_held_out(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rows = gam.score(docs, gam.fit(docs, labels)).selectExpr("row.doc_id", "score", "predicted").join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 40
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_training_leaves_out_the_held_out_fifth(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(50), 3, 3]] + [(None, 1), (4, None)], "doc_id long, quality int")
    rows = gam.training_rows(docs, labels, "quality", "doc_id", 1000).collect()
    assert sorted(r.doc_id for r in rows) == [i for i in range(50) if zlib.crc32(str(i).encode()) % 5]
    assert gam.training_rows(docs, labels, "quality", "doc_id", 7).count() == 7


def test_without_labels_or_rows(odd_docs, odd_rows, no_docs):
    labels = odd_docs.select("doc_id", F.lit(1).alias("quality"))
    none = labels.where("false")
    for model in (gam.fit(odd_docs, none), gam.fit(odd_docs, labels), gam.fit(no_docs, labels)):
        assert gam.score(odd_docs, model).where("predicted = 1").count() == len(odd_rows)
    assert gam.score(no_docs, gam.Gam()).count() == 0
    assert crf.judged(no_docs, crf.fit(no_docs, none)).count() == 0
    assert np.allclose(crf.fit(odd_docs, none).weights, 0)


def test_interaction_is_learnt():
    own = np.random.default_rng(5)
    x = own.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit_tables(x[:3000], y[:3000])
    assert (1, 0) in model.pairs
    assert np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.95


def test_measures_of_empty_texts():
    values = gam.measures(*text_bytes(pa.array([None, "", "a b\na b", "x" * (3 << 20)])))
    assert values.shape == (4, len(gam.FEATURES)) and not values[:2].any() and np.isfinite(values).all()
