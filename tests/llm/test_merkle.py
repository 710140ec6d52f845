import hashlib
import zlib

import duckdb
import pytest
from conftest import *  # noqa: F403
from pyspark.sql import functions as F

from feederlake.llm import merkle, queries

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_ways(leaves):
    """The root over the leaves and, for each, its runs and slots level by level."""
    now, at, ways = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(now) > 1:
        for way, i in zip(ways, at, strict=True):
            way.append((i % 3, now[i - i % 3:i - i % 3 + 3]))
        now, at = [h(*now[i:i + 3]) for i in range(0, len(now), 3)], [i // 3 for i in at]
    return now[0] if now else None, ways


def plain_fold(digest, way):
    for slot, run in way:
        digest = h(*run[:slot], digest, *run[slot + 1:])
    return digest


def plain(rows):
    """(doc_id, leaf, subroot, root, proof hash, folded root, verified) of rows in the order of COLUMNS."""
    low = lambda v: (v is not None, v if v is not None else 0)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in sources:
        own = sorted(((r, plain_leaf(r)) for r in rows if r[1] == source), key=lambda x: (low(x[0][0]), x[1]))
        trees.append((own, *plain_ways([d for _, d in own])))
    root, over = plain_ways([t[1] for t in trees])
    out = []
    for (own, subroot, ways), upper in zip(trees, over, strict=True):
        for (row, digest), way in zip(own, ways, strict=True):
            claim = digest
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                claim = plain_leaf((*row[:4], row[4].replace("\n", "")))
            whole = way + upper
            proof = h(*(d for slot, run in whole for i, d in enumerate(run) if i != slot))
            folded = plain_fold(claim, whole)
            out.append((row[0], digest, subroot, root, proof, folded, folded == root))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


def test_query_on_the_test_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*COLUMNS)
    want = plain([tuple(r) for r in docs.collect()])
    assert ordered(queries.op13_merkle(spark, folder).collect()) == ordered(want)
    assert {r[-1] for r in want} == {True, False}


def test_same_as_sql(spark, folder):
    docs = duckdb.connect()
    docs.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    mine = queries.op13_merkle(spark, folder)
    assert ordered(docs.sql(queries.SQL["op13_merkle"]).fetchall()) == ordered(mine.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("height", [1, 2])
def test_several_stories(spark, height):
    rows = [(i, f"s{i % 5 if i % 3 else 0}", "en", None, f"text\n{i}") for i in range(70)]
    rows += [(None, None, None, None, None), (7, "lone", None, 3, "a\nb")] + [(3, "s0", "en", 1, "x")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    check(docs, rows, height=height)


def check(docs, rows, **settings):
    tampered = F.when(F.expr("crc32(cast(doc_id AS string)) % 2 = 0"), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.manifest(docs, COLUMNS, {"text": tampered}, **settings).collect()
    mine = [(r.doc_id, r.leaf, r.subroot, r.root, h(r.proof), r.folded_root, r.folded_root == r.root) for r in got]
    assert ordered(mine) == ordered(plain(rows))
    assert all(merkle.verified(r.leaf, r.slots, r.proof) == r.root for r in got)


def test_odd_rows(odd_docs):
    check(odd_docs, [tuple(r) for r in odd_docs.select(*COLUMNS).collect()])


def test_one_row_and_none(spark, no_docs):
    one = spark.createDataFrame([(1, None, "a\n")], "doc_id long, source string, text string")
    row = merkle.manifest(one, ("doc_id", "source", "text")).first()
    assert row.leaf == row.subroot == row.root == row.folded_root == h("1:1", "-", "2:a\n") and row.proof == row.slots == ""
    assert merkle.manifest(no_docs, COLUMNS).count() == 0


def test_a_changed_row_resumes_the_state_before_its_slot():
    digests = [h(str(i)).encode() for i in range(20)]
    block = merkle.Block(digests, merkle.levels(20, 7))
    for i in range(20):
        now = [*digests[:i], b"0" * 64, *digests[i + 1:]]
        assert block.fold(i, b"0" * 64) == merkle.Block(now, merkle.levels(20, 7)).tree[-1][0]
        assert block.fold(i, digests[i]) == block.tree[-1][0]
