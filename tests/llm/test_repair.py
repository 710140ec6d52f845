import functools
import hashlib
import random
import re
import zlib

import pytest
from conftest import *  # noqa: F403
from pyspark.sql import functions as F

from feederlake.llm import queries, repair

SPACE = " \t\n\v\f\r"


def kinds(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best(rows, marks):
    """The least (cost, letters, repaired rows) by trying every edit everywhere."""
    follow = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
    full = {"u": "user", "a": "assistant"}

    @functools.cache
    def go(i, before, put):
        found = [(0, "", ())] if i == len(rows) and before in ("", "a") else []
        if put < 3:
            for s in ("u", "a"):
                if s in follow[before]:
                    found.append(tuple(a + b for a, b in zip((3, "I", ((full[s], ""),)), go(i, s, put + 1), strict=True)))
        if i < len(rows):
            _, role, text = rows[i]
            found.append(tuple(a + b for a, b in zip((4, "D", ()), go(i + 1, before, 0), strict=True)))
            if marks[i] not in ("blank", "duplicate"):
                more = 3 * (marks[i] == "truncated")
                if role[:1] in follow[before]:
                    found.append(tuple(a + b for a, b in zip((more, "K", ((role, text),)), go(i + 1, role[:1], 0), strict=True)))
                for s in ("u", "a"):
                    if s in follow[before]:
                        found.append(tuple(a + b for a, b in zip((3 + more, "R", ((full[s], text),)), go(i + 1, s, 0), strict=True)))
        return min(found) if found else (10 ** 6, "", ())

    return go(0, "", 0)


def plain(conv, rows):
    """The digests of one conversation, its rows given in any order."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    marks = kinds(rows)
    cost, audit, left = best(rows, marks)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in left))
    turns = {t for t, _, _ in rows if t is not None}
    first = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    said = "\n".join(f"{r}:{x}" for r, x in left)
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(marks.count, ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())


def damaged(conv, turn, role, text):
    role, text = " " if role is None else role, " " if text is None else text
    code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if code == 0:
        return []
    text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
    return [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0))


def grouped(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def test_query_on_the_test_table(spark, folder):
    table = grouped(map(tuple, spark.read.parquet(f"{folder}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()))
    want = [plain(c, [d for r in rows for d in damaged(c, *r)]) for c, rows in table.items()]
    got = queries.op12_conversation_repair(spark, folder).collect()
    assert ordered(got) == ordered(want)
    assert any("I" in r[7] for r in want) and any("R" in r[7] for r in want) and any("D" in r[7] for r in want)


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    own = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "sys", "ux", "", None]
    texts = ["yes.", "no!", "why? \n", "cut", "", " \t", "é。", None, "a.b"]
    rows = [(c if c else None, own.choice([None, *range(-3, 9), 1 << 60]), own.choice(roles[:own.randint(2, 8)]), own.choice(texts))
            for c in range(120) for _ in range(own.randint(1, 9))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    got = repair.digests(repair.repaired(turns)).collect()
    assert ordered(got) == ordered(plain(c, r) for c, r in grouped(rows).items())


def test_conversations_cross_batches(spark):
    """One conversation of many batches, with repeats of one row far apart, side by side, and without a turn."""
    own = random.Random(5)
    rows = [(2, i if i % 50 else None, own.choice(["user", "assistant"]), own.choice(["one.", "two", f"n{i}."])) for i in range(600)]
    rows += [(2, 77, "user", "same.")] * 40
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)


    edits = repair.repaired(turns)
    got = repair.digests(edits).first()
    marks = kinds(sorted((r[1:] for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])))
    assert (got.blank, got.duplicate, got.truncated) == tuple(map(marks.count, ("blank", "duplicate", "truncated")))
    left = edits.where("edit <> 'D' AND edit <> ''").orderBy("step").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in left))
    assert got.repaired_sha256 == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in left).encode()).hexdigest()
    assert got.cost == edits.groupBy().sum("cost").first()[0]
    assert got.audit == "".join(r.edit for r in edits.orderBy("step").collect())


def test_rows_that_are_dropped_keep_their_conversation(spark):
    rows = [(1, 0, "user", "hi.", True), (2, 0, "user", "hi.", False), (None, None, None, None, True)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, absent boolean")
    got = repair.digests(repair.repaired(turns, absent=F.col("absent"))).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert ordered(got) == [(None, 0, 0, 0, 0, 0, 0, "", empty), (1, 0, 0, 0, 0, 0, 0, "", empty), plain(2, [(0, "user", "hi.")])]


def test_empty_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi.", "x", 3, True)],
                                 "conv_id long, turn long, role string, text string, mark string, place int, byte boolean")
    assert repair.digests(repair.repaired(rows)).count() == 1
    assert repair.digests(repair.repaired(rows.where("false"))).count() == 0


def test_missing_steps_are_refused(spark):
    turns = spark.createDataFrame([(1, i, "user", "hi.") for i in range(4)], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="not together"):
        repair.digests(repair.repaired(turns).where("step <> 2")).collect()
