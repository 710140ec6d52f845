import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from feederlake.llm import packing
from feederlake.llm.bpe import decode, encode, word_merges
from feederlake.llm.byte_tokens import byte_tokens

PIECES = ["a", "b", "e", " ", "  ", "\n", "é", "'s", "'LL", "1", "12", "\t", "\xa0", "\x85", "\x1c", "漢", "<|endoftext|>",
          "<|startoftext|>", ".", "!!", "Don't", "\r\n", " \n", "x́", "​", "Ω", "ΣΑΣ", "İ", "ß", "aaaa", "!!!!!!!", "ﬁ", "가"]


def samples(count):
    own = random.Random(count)
    return ["".join(own.choices(PIECES, k=own.randint(0, 12))) for _ in range(count)] + ["", " ", "a ", " a", "hahahaha"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_same_ids_as_the_library(name):
    path = public_tokenizers.path(name)
    library = tokenizers.Tokenizer.from_file(path)
    own = byte_tokens(path) if name.startswith("byte") else word_merges(path)
    texts = samples(6000) + [chr(c) + "x" + chr(c) + " " + chr(c) for c in range(0x2000)]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        assert own.encode(texts) == want
    if name.startswith("word"):
        for text, ids in list(zip(texts, want, strict=True))[::7]:
            number = np.frombuffer(ids, dtype="<u4")
            assert own.decode(number).decode() == library.decode(number.tolist(), skip_special_tokens=False), text


def test_merges_that_open_lower_ranks_go_step_by_step():
    """With such merges, marked on purpose, the result must be the same as without."""
    merges = word_merges(public_tokenizers.path("word_bpe_49k.json"))
    words = [w.encode() for w in ("hahahahaha", "aaaaaaa", "bananananana", "thethethe", "x")]
    want = merges.merge(words)
    saved, merges.stepwise = merges.stepwise, np.ones_like(merges.stepwise)
    try:
        assert merges.merge(words) == want
    finally:
        merges.stepwise = saved


def test_encoded_documents(odd_docs, odd_rows, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = decode(encode(odd_docs, path), path).select("row.doc_id", "row.text", "ids", "decoded").collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), dtype="<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert encode(no_docs, path).count() == 0


def test_packed_documents(odd_docs, odd_rows, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = [r for r in packing.pack(odd_docs, path, capacity=256, keep_ids=True).collect()]
    ids = {}
    for i, t in odd_rows:
        ids.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    at = {}
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
        assert r.length == 256 or r.piece == 0
        assert any(whole[r.start:r.start + r.length] == r.ids for whole in ids[r.doc_id])
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(len(w) for ws in ids.values() for w in ws)
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.pack(no_docs, path).count() == 0


def test_few_sequences():
    own = np.random.default_rng(2)
    sizes = np.concatenate([own.integers(1, 1025, 20_000), np.minimum(1024, own.lognormal(5.3, 0.8, 20_000).astype(int) + 1)])
    lengths, counts = np.unique(sizes, return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    where = packing.plan(histogram, 1024)
    least = -(-int(sizes.sum()) // 1024)
    assert least <= where.sequences <= least * 1.001 + 5
    length = np.repeat(lengths, counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    sequence, offset = where.place(length, rank)
    order = np.lexsort((offset, sequence))
    sequence, offset, length = sequence[order], offset[order], length[order]
    first = np.concatenate(([True], sequence[1:] != sequence[:-1]))
    assert (offset[first] == 0).all()
    assert (offset[1:] == offset[:-1] + length[:-1])[~first[1:]].all()
    assert (offset + length <= 1024).all() and len(np.unique(sequence)) == where.sequences


def test_best_fit_is_best_fit():
    counts = packing.best_fit(np.array([3, 5, 7]), np.array([2, 2, 1]), 10)
    assert sorted(tuple(c) for c in counts) == [(0, 2, 0), (1, 0, 0), (1, 0, 1)]


def test_equal_lengths_are_numbered_apart(spark):
    """A length that all rows share is numbered in salted groups."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("hello").alias("text"))
    saved, packing.NUMBERED_TOGETHER = packing.NUMBERED_TOGETHER, 20
    try:
        rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=16).collect()
    finally:
        packing.NUMBERED_TOGETHER = saved
    assert len({(r.sequence_id, r.offset) for r in rows}) == 500
    assert len({r.sequence_id for r in rows}) == -(-500 // (16 // rows[0].length))


def plain_best_fit(pieces, capacity):
    """One piece after the other, longest first, each into the fullest sequence that takes it."""
    rooms, held = [], []
    for size in sorted(pieces, reverse=True):
        fitting = [i for i, room in enumerate(rooms) if room >= size]
        if fitting:
            at = min(fitting, key=lambda i: rooms[i])
        else:
            at = len(rooms)
            rooms.append(capacity)
            held.append([])
        rooms[at] -= size
        held[at].append(size)
    return held


def fewest(pieces, capacity):
    """The least number of sequences, by trying all subsets."""
    full = (1 << len(pieces)) - 1
    best = {0: (0, capacity)}
    for mask in range(1, full + 1):
        found = []
        for i, size in enumerate(pieces):
            if mask >> i & 1:
                used, filled = best[mask ^ (1 << i)]
                found.append((used, filled + size) if filled + size <= capacity else (used + 1, size))
        best[mask] = min(found)
    return best[full][0]


def histogram(sizes):
    lengths, wanted = np.unique(np.array(sizes), return_counts=True)
    return lengths.astype(np.int64), wanted.astype(np.int64)


def test_groups_are_best_fit():
    own = np.random.default_rng(4)
    for _ in range(40):
        sizes = own.integers(1, own.integers(3, 60), own.integers(1, 300)).tolist()
        lengths, wanted = histogram(sizes)
        groups = packing.best_fit_groups(lengths, wanted, 60)
        assert (sum(times * counts for times, counts in groups) == wanted).all()
        # which of two equally full sequences takes a piece is open, how full they get is not
        got = sorted(int(counts @ lengths) for times, counts in groups for _ in range(times))
        assert got == sorted(sum(h) for h in plain_best_fit(sizes, 60))


def test_price_is_the_dearest_configuration():
    own = np.random.default_rng(5)
    for _ in range(30):
        capacity = int(own.integers(5, 14))
        lengths = np.unique(own.integers(1, capacity + 1, 4))
        prices = own.random(len(lengths))
        counts, price = packing._price(prices, lengths, capacity)
        every = np.array(np.meshgrid(*[np.arange(capacity // n + 1) for n in lengths])).reshape(len(lengths), -1).T
        assert counts @ lengths <= capacity and abs(counts @ prices - price) < 1e-9
        assert abs(price - (every[every @ lengths <= capacity] @ prices).max()) < 1e-9


def test_bound_and_plan_against_the_optimum():
    own = np.random.default_rng(6)
    for _ in range(15):
        sizes = own.integers(3, 30, 11).tolist()
        lengths, wanted = histogram(sizes)
        least = fewest(sizes, 30)
        cover = packing.solve(lengths, wanted, 30)
        assert cover.bound <= least + 1e-6
        where = packing.plan(dict(zip(lengths.tolist(), wanted.tolist(), strict=True)), 30)
        assert least <= where.sequences <= len(plain_best_fit(sizes, 30))


def test_prices_prove_more_than_the_volume():
    """Pieces of over half a sequence cannot share one: prices find that, the volume does not."""
    lengths, wanted = np.array([3, 5, 6, 7]), np.array([4, 50, 300, 200])
    cover = packing.solve(lengths, wanted, 10)
    assert cover.bound > 1.1 * (lengths @ wanted) / 10 and cover.bound > 495


def test_solution_covers_every_demand():
    """Scaled up, the average covers all; rounded, a plan of any size stays near the bound and below plain best-fit."""
    own = np.random.default_rng(7)
    lengths = np.arange(1, 129)
    wanted = own.integers(1, 10**9, 128)
    cover = packing.solve(lengths, wanted, 128)
    met = cover.times @ cover.counts
    assert (met > 0).all() and abs(cover.times.sum() - cover.bound) < 1e-6 * cover.bound
    assert ((cover.counts @ lengths) <= 128).all()
    where = packing.plan(dict(zip(lengths.tolist(), wanted.tolist(), strict=True)), 128)
    assert cover.bound <= where.sequences <= 1.02 * cover.bound + len(lengths)
    assert where.sequences <= sum(times for times, _ in packing.best_fit_groups(lengths, wanted, 128))
    for share in packing.SHARES:
        used = packing.rounded(cover, share, lengths, wanted, 128)
        assert (sum(times * counts for times, counts in used) == wanted).all()
