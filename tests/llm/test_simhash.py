import random

import numpy as np
import pytest
import xxhash
from conftest import *  # noqa: F403
from pyspark.sql import functions as F

from feederlake.llm import components, simhash


def plain_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_same_hash_as_spark(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("one two é"))).first()[0]
    assert row % (1 << 64) == xxhash.xxh64_intdigest("one two é".encode(), 42)


def test_near_duplicates(odd_docs, odd_rows):
    got = simhash.near_duplicates(odd_docs).collect()
    marks = [plain_fingerprint(t, 3) for _, t in odd_rows]
    part = classes(set(marks), [(a, b) for a in set(marks) for b in set(marks) if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for (i, _), m in zip(odd_rows, marks, strict=True):
        if i is not None:
            least[part[m]] = min(i, least.get(part[m], i))
    key = lambda r: (r[0] is None, r[0], r[1])
    want = sorted([(i, format(m, "016x"), least.get(part[m])) for (i, _), m in zip(odd_rows, marks, strict=True)], key=key)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=key) == want


def test_pieces_do_not_change_fingerprints():
    text = " ".join(f"w{i % 997}" for i in range(400_000)).encode()
    assert len(text) > 1 << 20
    assert simhash.fingerprint(text, 3) == plain_fingerprint(text.decode(), 3)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_all_links_are_found(spark, radius):
    own = random.Random(radius)
    marks = {own.getrandbits(64) for _ in range(60)}
    for m in list(marks):
        for _ in range(3):
            m ^= 1 << own.randrange(64)
            marks.add(m)
    rows = [(int(np.uint64(m).astype(np.int64)),) for m in marks]
    pairs = simhash.linked_fingerprints(spark.createDataFrame(rows, "fingerprint long"), radius).collect()
    found = {(r.lo % (1 << 64), r.hi % (1 << 64)) for r in pairs}
    assert all((a ^ b).bit_count() <= radius for a, b in found)
    want = [(a, b) for a in marks for b in marks if a < b and (a ^ b).bit_count() <= radius]
    assert len(set(classes(marks, found).values())) == len(set(classes(marks, want).values()))


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.without_near_copies(no_docs).count() == 0


def test_components(spark):
    own = random.Random(3)
    edges = [(i, i + 1) for i in range(150)] + [(500 + own.randrange(80), 500 + own.randrange(80)) for _ in range(60)]
    edges += [(7, 7), (None, 3), (900, None), (1000, 1001), (1001, 1000), (1000, 1001)]
    got = {r.node: r.component for r in components.components(
        spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    clean = [e for e in edges if None not in e]
    want = classes({n for e in clean for n in e}, clean)
    assert got == {n: c for n, c in want.items() if n != c}


def test_components_look_at_each_round_once(spark, monkeypatch):
    looks, rounds = [], []
    state, settle = components._state, components.settle
    monkeypatch.setattr(components, "_state", lambda edges: looks.append(1) or state(edges))
    monkeypatch.setattr(components, "settle", lambda df, label: rounds.append(1) or settle(df, label))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert components.components(edges, "a", "b").where("component = 0").count() == 40
    assert len(looks) == len(rounds) > 2


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = simhash.without_near_copies(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a < b and alike(sets[a], sets[b]) >= 0.8]
    part = classes(set(texts), pairs)
    assert ids == {c for c in part.values()}


def test_near_copies_odd(odd_docs, odd_rows):
    kept = simhash.without_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert (1, None) in rows and (2, "") not in rows  # texts without words are copies of each other
    assert sum(i == 17 for i, _ in rows) == 2  # the same id with another text is another document
    assert [i for i, t in rows if t in (dict(odd_rows)[6], dict(odd_rows)[20])] == [6]
    assert sum(i is None for i, _ in rows) == 1


def meetings(spark, pairs):
    """How many of the pairs of texts are brought down to one."""
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    ids = {r.doc_id for r in simhash.without_near_copies(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    return sum(2 * i + 1 not in ids for i in range(len(pairs)))


def edited(own, size, gone):
    """Two texts of `size` words, all different; `gone` words at the end of the second are others."""
    words = [f"{own.getrandbits(40):x}" for _ in range(size)]
    return " ".join(words), " ".join(words[:size - gone] + [f"{own.getrandbits(40):x}" for _ in range(gone)])


@pytest.mark.parametrize(("gone", "least"), [(22, 0.92), (18, 0.96), (10, 0.99)])
def test_chance_to_meet(spark, gone, least):
    """At similarities of 0.8, 0.84 and 0.9: what meets is compared, whatever the distance of the fingerprints."""
    own = random.Random(gone)
    pairs = [edited(own, 204, gone) for _ in range(600)]
    assert all(0.8 <= alike(*map(shingles, p)) for p in pairs[:20])
    assert meetings(spark, pairs) >= least * len(pairs)


def test_repeated_lines_do_not_hide_near_copies(spark):
    own = random.Random(12)
    pairs = []
    for _ in range(60):
        text, other = edited(own, 204, 5)
        line = " ".join(text.split()[:25])
        pairs.append((text, other + f" {line}" * 60))
    assert all(0.8 <= alike(*map(shingles, p)) for p in pairs)
    assert meetings(spark, pairs) >= 55


def test_copies_behind_strangers(spark):
    """A family at a similarity of 0.75, each with a twin: twins are found although another text is smallest where they meet."""
    own = random.Random(5)
    word = lambda n: [f"{own.getrandbits(40):x}" for _ in range(n)]
    core, texts = word(180), []
    for _ in range(60):
        tail = word(30)
        texts += [" ".join(core + tail), " ".join(core + tail[:-1] + word(1))]
    assert alike(shingles(texts[0]), shingles(texts[2])) < 0.78 and alike(shingles(texts[0]), shingles(texts[1])) > 0.97
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in simhash.without_near_copies(docs).collect()} == set(range(0, 120, 2))


def test_rounds_find_all_links_of_a_place(spark):
    own = random.Random(9)
    pool = [own.sample(range(60), 30) for _ in range(6)]
    sets = [sorted(set(own.choice(pool)) ^ set(own.sample(range(60), own.randint(0, 9)))) for _ in range(60)]
    want = [(a, b) for a in range(60) for b in range(a) if alike(set(sets[a]), set(sets[b])) >= 0.8]
    part = classes(set(range(60)), want)
    members = spark.createDataFrame([(p, i) for p in range(2) for i in range(60)], "place long, k2 long")
    sizes = spark.createDataFrame([(i, len(x)) for i, x in enumerate(sets)], "k2 long, size long")
    rows = spark.createDataFrame(list(enumerate(sets)), "k2 long, shingles array<long>")
    got = {r.node: r.component for r in simhash.linked_texts(members, sizes, rows, 0.8).collect()}
    assert got == {i: c for i, c in part.items() if i != c} and 3 < len(set(part.values())) < 60


def test_fingerprints_tie_near_copies(spark, monkeypatch):
    """Near copies within two bits are found by their fingerprints alone; a tie of texts that are not similar does not count."""
    own = random.Random(21)
    texts = [t for _ in range(40) for t in edited(own, 1000, 1)]
    marks = [simhash.majority_bits([simhash.shingle_set(t.encode(), 5)]) for t in texts]
    far = [i for i in range(0, 80, 2) if (marks[i] ^ marks[i + 1]).bit_count() > 2]
    assert len(far) < 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(simhash, "candidates", lambda nodes, similarity: nodes.select("k2").limit(0))
    monkeypatch.setattr(simhash, "rare_places", lambda texts, width, similarity: spark.createDataFrame(
        [], "place long, k2 long, size long, reach long"))
    kept = {r.doc_id for r in simhash.without_near_copies(docs).collect()}
    assert kept == set(range(0, 80, 2)) | {i + 1 for i in far}
    strangers = spark.createDataFrame([(i, edited(own, 30, 0)[0]) for i in range(20)], "doc_id long, text string")
    monkeypatch.setattr(simhash, "majority_bits", lambda pieces: 7)
    assert simhash.without_near_copies(strangers).count() == 20
