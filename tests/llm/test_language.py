import collections
import math
import random
import zlib

import numpy as np
import pytest
from conftest import *  # noqa: F403
from pyspark.sql import functions as F

from feederlake.llm import language, queries

TEXTS = ["", "Über den Fluß", "a", "  x\n\ty! x", "1234 ...", "日本語の text", "ab" * 40, "naïve été", "İI ſ"]


def plain_grams(text, longest):
    """The n-grams of a text, character by character."""
    low = f" {text.lower()} "
    word = ["L" if language._kinds()[ord(c)] else " " for c in low]
    out = ""
    for c, w in zip(low, word, strict=True):
        c = c if w == "L" else " "
        if c != " " or not out.endswith(" "):
            out += c
    grams = collections.Counter(out[i:i + n] for n in range(1, longest + 1) for i in range(len(out) - n + 1))
    del grams[" "]
    return grams


def plain_bucket(gram):
    a, b, low = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1
    h = ord(gram[0]) * a & low
    for c in gram[1:]:
        h = (h * b + ord(c)) & low
    return ((h ^ h >> 31) * a & low) >> 64 - language.BITS


def test_counts_are_those_of_all_grams():
    row, bucket, count, lettered = language.gram_counts(TEXTS, 4)
    want = []
    for i, text in enumerate(TEXTS):
        sums = collections.Counter()
        for gram, n in plain_grams(text, 4).items():
            sums[plain_bucket(gram)] += n
        want += [(i, b, n) for b, n in sorted(sums.items())]
    assert list(zip(row.tolist(), bucket.tolist(), count.tolist(), strict=True)) == want
    assert lettered.tolist() == [any(c.isalpha() for c in t) for t in TEXTS]


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = "der Hund und die Katze " * 50
    whole = language.gram_counts([text, "x", text])
    monkeypatch.setattr(language, "PART", 23)  # cuts at a blank
    row, bucket, count, _ = language.gram_counts([text, "x", text])
    of = lambda r, b, c: {k: n for k, n in zip(zip(r.tolist(), b.tolist(), strict=True), c.tolist(), strict=True)}
    assert sorted(zip(row, bucket, strict=True)) == list(zip(row, bucket, strict=True))
    cut, full = of(row, bucket, count), of(*whole[:3])
    assert set(cut) <= set(full) and all(0 <= full[k] - n <= 100 for k, n in cut.items())


def test_weights_follow_the_regularised_leader():
    """The update of one coordinate at a time, written out."""
    own = random.Random(2)
    rows, label = [], []
    for _ in range(40):
        at = sorted(own.sample(range(12), own.randint(1, 6)))
        rows.append((np.array(at), np.array([own.random() for _ in at])))
        label.append(own.randrange(3))
    alpha, beta, l1, l2 = 0.7, 1.3, 0.05, 0.02
    weights, bias = language.fit_weights(rows, np.array(label), 3, 2, alpha, beta, l1, l2, seed=4)
    z, n, w = ([[0.0] * 3 for _ in range(13)] for _ in range(3))
    order = np.random.default_rng(4)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            entries = [*zip(rows[i][0].tolist(), rows[i][1].tolist(), strict=True), (12, 1.0)]
            scores = [sum(x * w[b][k] for b, x in entries) for k in range(3)]
            e = [math.exp(s - max(scores)) for s in scores]
            for b, x in entries:
                for k in range(3):
                    g = x * (e[k] / sum(e) - (k == label[i]))
                    sigma = (math.sqrt(n[b][k] + g * g) - math.sqrt(n[b][k])) / alpha
                    z[b][k] += g - sigma * w[b][k]
                    n[b][k] += g * g
                    lasso = l1 if b < 12 else 0
                    w[b][k] = 0.0 if abs(z[b][k]) <= lasso else -(z[b][k] - math.copysign(lasso, z[b][k])) / (
                        (beta + math.sqrt(n[b][k])) / alpha + l2)
    assert np.allclose(weights[:12], w[:12]) and np.allclose(bias, w[12]) and not weights[12:].any()
    assert 0 < (weights[:12] == 0).sum() < 36


def test_temperature_is_the_best_one():
    own = np.random.default_rng(1)
    label = own.integers(0, 3, 500)
    scores = own.normal(size=(500, 3)) * 4
    scores[np.arange(500), label] += 3
    best = language.fit_temperature(scores, label)
    loss = lambda t: -np.log(language.softmax(scores / t)[np.arange(500), label]).mean()
    assert min(loss(t) for t in np.geomspace(0.1, 10, 60)) >= loss(best) - 2e-3 and best > 1
    assert language.fit_temperature(np.zeros((0, 3)), np.zeros(0, dtype=int)) == 1


@pytest.fixture(scope="module")
def table(spark, folder):
    return folder.replace("sf0.001", "sf0.01")


def test_query_knows_held_out_documents(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet").select("doc_id", "lang", "text").toPandas()
    got = queries.op11_language(spark, table).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) and list(got.columns[:4]) == ["doc_id", "held_out", "lang_pred", "score"]
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out, strict=True))
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    assert abs(held.score.mean() - (held.lang == held.lang_pred).mean()) < 0.1


def test_nothing_is_learnt_from_held_out_rows(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet").limit(150)
    wrong = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = language.fit(docs), language.fit(wrong.withColumn(
        "text", F.when(language.held_out(F.col("doc_id")), "zzz").otherwise(F.col("text"))))
    assert a.languages == b.languages and np.array_equal(a.idf, b.idf) and np.array_equal(a.weights, b.weights)


def test_odd_rows(odd_docs, spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    model = language.fit(docs, max_rows=200)
    got = language.predict(odd_docs, model)
    assert got.select("row.*").schema == odd_docs.schema and got.count() == odd_docs.count()
    for r in got.selectExpr("row.text", "lang_pred", "score").collect():
        if any(c.isalpha() for c in r.text or ""):
            assert r.lang_pred in model.languages and 0 < r.score <= 1
        else:
            assert (r.lang_pred, r.score) == ("und", 0)


def test_no_rows_and_no_languages(spark, no_docs, odd_docs):
    model = language.fit(no_docs)
    assert model.languages == [] and language.predict(no_docs, model).count() == 0
    assert {tuple(r) for r in language.predict(odd_docs, model).select("lang_pred", "score").collect()} == {("und", 0.0)}
    nameless = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.fit(nameless).languages == []


def test_sample_is_bounded_and_even(spark):
    rows = [(i, "en" if i % 10 else f"l{i % 30}", f"text {i % 400}") for i in range(2000)] + [(7, "en", "text")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = language.chosen_rows(docs, 50, 120, 1).collect()
    assert len(got) == 120 and collections.Counter(r.lang for r in got) == {"en": 30, "l0": 30, "l10": 30, "l20": 30}
