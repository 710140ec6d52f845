import random
from collections import Counter

import numpy as np
import pytest

from feederlake.llm import repeats
from feederlake.llm.suffix_array import repeated_starts, suffix_array


@pytest.mark.parametrize("alphabet", [b"ab", b"abcd", b"a", bytes(range(256))])
def test_suffix_array(alphabet):
    own = random.Random(len(alphabet))
    for turn in range(120):
        text = bytes(own.choices(alphabet, k=own.randint(0, 250)))
        text = text[:20] * own.randint(1, 8) if turn % 4 == 0 else text
        array = np.frombuffer(text, dtype=np.uint8)
        assert suffix_array(array, 300).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        short = suffix_array(array, 6).tolist()
        assert sorted(short) == list(range(len(text)))
        assert all(text[a:a + 6] <= text[b:b + 6] for a, b in zip(short, short[1:], strict=False))


def test_repeated_starts():
    text = np.frombuffer(b"abcdefghij--abcdefghij--abcdefghiX", dtype=np.uint8)
    allowed = np.zeros(len(text), dtype=bool)
    allowed[[0, 12, 24, 5]] = True
    assert np.flatnonzero(repeated_starts(text, allowed, 10)).tolist() == [0, 12]


def plain(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    counts = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (key, text), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - length + 1):
            if counts[b[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int(np.sum(gone & ~np.concatenate(([False], gone[:-1]))))
        out.append((key, text, bytes(np.frombuffer(b, dtype=np.uint8)[~gone]), len(b), int(gone.sum()), spans))
    return sorted(out, key=repr)


def found(docs, length, **settings):
    rows = repeats.without_repeats(docs, length=length, **settings).select(
        "row.doc_id", "row.text", "kept", "n_bytes", "n_removed", "n_spans").collect()
    return sorted([(r[0], r[1], bytes(r[2]), r[3], r[4], r[5]) for r in rows], key=repr)


def short_rows(odd_rows):
    return [(i, t and t[:20_000]) for i, t in odd_rows]


def test_repeats_are_removed(spark, odd_rows):
    rows = short_rows(odd_rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(docs, 200) == plain(rows, 200)


def test_crowded_anchors_and_small_blocks(spark):
    """Many different surroundings of one passage, so that its anchors go separate ways and routes outgrow a block."""
    own = random.Random(8)
    passage = "".join(own.choices("abcdefgh ", k=150))
    rows = [(i, "".join(own.choices("xyz", k=own.randint(0, 60))) + passage + "".join(own.choices("xyz", k=own.randint(0, 60))))
            for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain(rows, 100)
    assert sum(w[4] for w in want) > 40_000
    assert found(docs, 100, together=10, block=2_000) == want
    assert found(docs, 100, block=5_000) == want


def test_long_texts_and_cut_characters(spark, odd_docs, odd_rows):
    long = dict(odd_rows)[11]
    assert len(long.encode()) > 1 << 20
    got = {r.doc_id: r for r in repeats.without_repeats(odd_docs, as_text=True).select("row.doc_id", "kept", "n_removed").collect()}
    assert got[11].n_removed == 3000 and got[12].n_removed == 3000 and got[11].kept == long[3000:]
    assert got[13].kept == "" and got[1].kept == "" and got[4].kept == "one"


def test_empty(no_docs):
    assert repeats.without_repeats(no_docs).count() == 0
    with pytest.raises(ValueError):
        repeats.without_repeats(no_docs, length=64)


def test_copies_of_a_string_do_not_fill_a_task(spark):
    """A passage in different surroundings in every document: its anchors are crowded, and no route holds all copies."""
    own = random.Random(13)
    passage = "".join(own.choices("abcdefgh ", k=140))
    rows = [(i, "".join(own.choices("xyz", k=50)) + passage + "".join(own.choices("xyz", k=50))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen, usual = [], repeats._settled
    repeats._settled = lambda windows, *more: seen.append(windows) or usual(windows, *more)
    try:
        assert found(docs, 100, together=50) == plain(rows, 100)
    finally:
        repeats._settled = usual
    assert max([r[1] for r in seen[0].groupBy("route").count().collect()], default=0) <= 50
