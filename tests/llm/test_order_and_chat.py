import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest

from feederlake.llm import chat, order_minhash

A, B, FULL = int(order_minhash._A), int(order_minhash._B), (1 << 64) - 1
PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["<", "s>", "/s>", "\\", "[", "INST]", "/INST]", "<s>", "</s>", "[ROLE]", "x", " ", "<\\s>", "é", "漢", "<|endoftext|>"]


def test_neighbours_and_edits(odd_docs, odd_rows):
    rows = order_minhash.compared(odd_docs).collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        text, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        want.append((i, len(text), text[:len(text) - half] + after[:half]))
    assert sorted([(r.doc_id, r.n_chars, r.edited) for r in rows], key=repr) == sorted(want, key=repr)
    marks = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        marks.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert marks[6] == marks[7] and marks[1] == marks[2] and marks[13] == marks[14]
    assert len(marks[17]) == 2
    assert next(r.near_next for r in rows if r.doc_id == 7) == 1.0
    assert next(r.near_edited for r in rows if r.doc_id == 16) > next(r.near_next for r in rows if r.doc_id == 16)


def test_one_row_and_none(odd_docs, no_docs):
    row = order_minhash.compared(odd_docs.where("doc_id = 16")).collect()
    assert len(row) == 1 and row[0].near_next == 1.0
    assert order_minhash.compared(no_docs).count() == 0


def marks(texts):
    return order_minhash._marks(texts)


def test_fingerprints_do_not_depend_on_company():
    own = random.Random(2)
    texts = [" ".join("".join(own.choices("abcd", k=own.randint(1, 12))) for _ in range(own.randint(0, 60))) for _ in range(40)]
    together = marks(texts)
    for text, mark in zip(texts, together, strict=True):
        assert (marks([text])[0] == mark).all()


def plain_letters(text):
    """The letters of a text as byte strings, by a loop over its words."""
    found = []
    for word in re.findall(rb"[^\x20\x09-\x0d]+", text.encode()):
        if len(word) <= order_minhash.LONG:
            found += [word[i:i + 4] for i in range(0, len(word), 4)]
            continue
        start = 0
        for i in range(1, len(word) + 1):
            number = 0
            for b in reversed(word[max(0, i - 4):i]):
                number = (number * A + b + 1) & FULL
            chosen = i >= 4 and stir(stir(number)) >> 62 == 0
            if i == len(word) or chosen or i - start == order_minhash.LONGEST:
                found.append(word[start:i])
                start = i
    return found


def stir(x):
    x = ((x ^ (x >> 31)) * B) & FULL
    return x ^ (x >> 29)


def plain_fingerprint(text):
    """Order MinHash of one text in plain numbers: minimal numbered k-mers in text order, hashed as tuples."""
    numbers = []
    for letter in plain_letters(text):
        total, power = 0, 1
        for b in letter:
            power = power * A & FULL
            total = (total + (b + 1) * power) & FULL
        numbers.append(stir(total))
    kmers = []
    for i in range(max(len(numbers) - 2, min(1, len(numbers)))):
        mixed = 0
        for step, number in enumerate(numbers[i:i + 3]):
            mixed = stir((mixed * A + number + step + 1) & FULL)
        kmers.append(mixed)
    seen, numbered = {}, []
    for k in kmers:
        seen[k] = seen.get(k, -1) + 1
        numbered.append(stir((k + seen[k] * A) & FULL))
    out = []
    for sketch in range(order_minhash.SKETCHES):
        ranks = []
        for i, n in enumerate(numbered):
            rank = (n ^ int(order_minhash._SEEDS[sketch])) * A & FULL
            ranks.append((((rank ^ (rank >> 32)) * B & FULL) >> 24, i))
        chosen = sorted(i for _, i in sorted(ranks)[:2])
        mixed = sketch + 1
        for i in chosen + [None] * (2 - len(chosen)):
            mixed = stir((mixed * A + (0 if i is None else kmers[i])) & FULL)
        out.append(mixed >> 48 if kmers else 0)
    return out


def test_fingerprints_equal_a_plain_version(odd_rows):
    own = random.Random(7)
    texts = [t or "" for _, t in odd_rows if len(t or "") < 20_000]
    texts += ["".join(own.choices("abc \n漢字語é", k=own.randint(0, 300))) for _ in range(40)]
    texts += ["x" * 500, "ab" * 300, "漢" * 33, "w" * 32, "w" * 33, " " * 40 + "end", "one", "one two", "one two three"]
    for text, mark in zip(texts, marks(texts), strict=True):
        assert mark.tolist() == plain_fingerprint(text), text[:80]


def test_texts_without_blanks_keep_their_likeness_after_an_edit():
    own = random.Random(3)
    for alphabet in ("".join(chr(own.randint(0x4E00, 0x9FA5)) for _ in range(800)), "abcdefghijklmnopqrstuvwxyz"):
        text = "".join(own.choices(alphabet, k=600))
        base, *edited = marks([text, "新" + text, text[:300] + "新" + text[300:], text[:300] + text[301:], text[:450] + "q" + text[451:]])
        assert all((base == e).mean() >= 0.8 for e in edited)
        halves, other = marks([text[300:] + text[:300], "".join(own.choices(alphabet, k=600))])
        assert (base == halves).mean() < 0.8 and (base == other).mean() < 0.1


def test_order_matters_and_edits_show():
    own = random.Random(1)
    words = ["".join(own.choices("abcdefghij", k=6)) for _ in range(400)]
    text = " ".join(words)
    small = " ".join(words[:200] + ["changed"] + words[201:])
    halves = " ".join(words[200:] + words[:200])
    base, near, turned, other = marks([text, small, halves, " ".join(words[::-1])])
    like = lambda a, b: float((a == b).mean())
    assert like(base, near) > 0.85 > like(base, turned) > like(base, other)


def test_occurrences_are_numbered():
    kmer, starts = np.array([5, 5, 9, 5, 5, 9], dtype=np.uint64), np.array([0, 4, 6])
    number = order_minhash._numbered(kmer, starts)
    assert len(set(number[:4].tolist())) == 4  # 5, 5 again, 9, 5 a third time
    assert number[0] == number[4] and number[2] == number[5]  # each text counts for itself


def test_escape_round_trip():
    own = random.Random(1)
    for _ in range(5000):
        text = "".join(own.choices(PARTS, k=own.randint(0, 10)))
        role = "".join(own.choices(PARTS, k=2))
        assert chat.unescape(chat.escape(text)) == text and not chat._MARK.search(chat.escape(text))
        whole = chat.render(role, text)[0] + chat.render("assistant", text)[0] + chat.render("user", text)[0]
        assert list(chat.parse(whole)) == [(role, text), ("assistant", text), ("user", text)]


def test_mask_by_binary_search():
    starts, ends = np.array([0, 3, 5, 5, 7, 9]), np.array([3, 5, 7, 7, 9, 12])
    assert chat.loss_mask(starts, ends, [(3, 7), (7, 7), (9, 12)]).tolist() == [False, True, True, True, False, True]
    assert chat.loss_mask(starts[:0], ends[:0], []).tolist() == []


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_conversations(spark, block):
    own = random.Random(3)
    rows = [(c, t, own.choice(["user", "assistant", "system", None, "[INST]"]),
             own.choice([None, "", "".join(own.choices(PARTS, k=30))])) for c in range(30) for t in range(own.randint(1, 9))]
    rows += [(50, t, "assistant" if t % 2 else "user", "turn %d é漢 </s>" % t) for t in range(400)]
    rows += [(None, 1, "assistant", "no id"), (60, None, "user", "first"), (60, 0, "assistant", "b"), (60, 0, "assistant", "a"),
             (60, 0, "assistant", "a")]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, "
                                                               "formatted string, block int").repartition(4)
    blocks = chat.formatted(turns, PATH, block=block)
    got = {r.conv_id: r for r in chat.digests(blocks).collect()}
    assert (blocks.where("conv_id = 50").count() > 1) == (block == 200)
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, said in want.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert got[c].n_turns == len(said)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(chat.render(r, t)[0]) for r, t in said)
    assert chat.formatted(turns.where("false"), PATH).count() == 0


def test_tokens_cover_the_text(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi 漢"), (1, 1, "assistant", "né <s>")], "conv_id long, turn long, role string, text string")
    row = chat.formatted(turns, PATH).first()
    covered = {k for a, b in zip(row.token_start, row.token_end, strict=True) for k in range(a, b)}
    assert covered == set(range(len(row.formatted))) and len(row.ids) == len(row.loss)
