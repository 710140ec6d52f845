"""Merkle manifest of a table: a tree over the rows of each source, a tree over the sources, and a proof for each row.

A node is the SHA-256, in lowercase hex, of its children's hex digests. Every parent keeps a copy of its hash state
before each child, so that a changed child is folded by resuming that state with the new digest and the siblings to its
right; those to its left are not hashed again.

Trees are built in stories: 3 ** height consecutive nodes of a source are a block, whose top is a node of the next story.
A block is the largest thing a task holds, however many rows a source has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feederlake.llm.common import prepare
from feederlake.session import settle

#: Children of a node, and levels of a block.
ARITY, HEIGHT = 3, 7
_STEPS = "array<struct<slot: int, run: array<string>>>"


def encoded(value: Column) -> Column:
    """`-` for NULL, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row: no two different rows have the same input to the hash."""
    return F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256)


def levels(nodes: int, height: int) -> int:
    """Levels that a block adds to the tree of a source with that many nodes in this story."""
    if nodes > ARITY ** height:
        return height
    count = 0
    while nodes > 1:
        nodes, count = -(-nodes // ARITY), count + 1
    return count


class Block:
    """The nodes of a block, level by level, and the states of their parents before each child."""

    def __init__(self, digests: list[bytes], height: int):
        self.tree: list[list[bytes]] = [digests]
        self.states: list[list[list[object]]] = []
        for _ in range(height):
            below, parents, kept = self.tree[-1], [], []
            for at in range(0, len(below), ARITY):
                state, before = hashlib.sha256(), []
                for child in below[at:at + ARITY]:
                    before.append(state.copy())
                    state.update(child)
                parents.append(state.hexdigest().encode())
                kept.append(before)
            self.tree.append(parents)
            self.states.append(kept)

    def fold(self, at: int, digest: bytes) -> bytes:
        """The top of the block with another digest at that leaf."""
        for below, kept in zip(self.tree, self.states, strict=False):
            parent, slot = divmod(at, ARITY)
            state = kept[parent][slot].copy()
            state.update(digest)
            state.update(b"".join(below[at + 1:ARITY * (parent + 1)]))
            at, digest = parent, state.hexdigest().encode()
        return digest

    def steps(self, at: int) -> list[tuple[int, list[bytes]]]:
        """(slot, run) of the node above a leaf, and so on: its place among the children of its parent."""
        found = []
        for below in self.tree[:-1]:
            parent, slot = divmod(at, ARITY)
            found.append((slot, below[ARITY * parent:ARITY * (parent + 1)]))
            at = parent
        return found


class Way:
    """What lies above a block: a state to resume, and what stands to the right, at each level up to the root."""

    def __init__(self, steps: list[tuple[int, list[bytes]]]):
        self.slots = [(slot, len(run)) for slot, run in steps]
        self.siblings = b"".join(d for slot, run in steps for i, d in enumerate(run) if i != slot)
        self.resumed = []
        for slot, run in steps:
            state = hashlib.sha256()
            state.update(b"".join(run[:slot]))
            self.resumed.append((state, b"".join(run[slot + 1:])))

    def fold(self, digest: bytes) -> bytes:
        for state, right in self.resumed:
            state = state.copy()
            state.update(digest)
            state.update(right)
            digest = state.hexdigest().encode()
        return digest


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with `pos`, their number from 0 within their `source` in that order, and `n`, the rows of it.

    Rows are dealt out by ranges of (source, order) and numbered in place; only the counts of each source and range are
    added up. Rows that agree in everything are told apart by their place in the scan, so that copies spread as well.
    """
    keys = ["source", *order, "copy"]
    spread = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = settle(spread.drop("copy").withColumns(
        {"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "placed")
    own = Window.partitionBy("source")
    counts = placed.groupBy("source", "part").agg(F.count("*").alias("m"), F.min("at").alias("first")).select(
        F.col("source").alias("s"), F.col("part").alias("p"), "first",
        (F.sum("m").over(own.orderBy("part")) - F.col("m")).alias("before"), F.sum("m").over(own).alias("n"))
    joined = placed.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return joined.withColumn("pos", F.expr("at - first + before")).drop("part", "at", "s", "p", "first", "before")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each block; they stand next to each other, and a block and its way up are all that is held."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:2] != key:
                yield held
                held = []
            key = row[:2]
            held.append(row)
    if held:
        yield held


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("source", "block").sortWithinPartitions("source", "block", "pos")


def _in_blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {ARITY ** height}"))


def risen(nodes: DataFrame, height: int) -> DataFrame:
    """The next story (source, pos, n, digest): the top node of every block of (source, pos, n, digest)."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            source, block, _, n, _ = rows[0]
            top = Block([r[4].encode() for r in rows], levels(n, height)).tree[-1][0]
            yield pa.RecordBatch.from_pydict({
                "source": pa.array([source], pa.string()), "pos": [block], "n": [-(-n // span)], "digest": [top.decode()]})

    span = ARITY ** height
    dealt = _dealt(_in_blocks(nodes, height).select("source", "block", "pos", "n", "digest"))
    return dealt.mapInArrow(per_partition, "source string, pos long, n long, digest string")


def stories(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes and all stories above them; in the last one every source has one node."""
    most, found = nodes.agg(F.max("n")).first()[0] or 0, [nodes]
    while len(found) == 1 or most > 1:
        found.append(settle(risen(found[-1], height), "story"))
        most = -(-most // ARITY ** height)
    return found


def _met(nodes: DataFrame, above: DataFrame, height: int, columns: Sequence[str] = ()) -> DataFrame:
    """The nodes of each block, after one row (pos -1) with the way from its top to the root."""
    own = _in_blocks(nodes, height).select(
        "source", "block", "pos", "n", "digest", *columns, F.lit(None).cast(_STEPS).alias("steps"),
        F.lit(None).cast("string").alias("subroot"))
    blank = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in columns]
    top = above.select(
        "source", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("n"),
        F.lit(None).cast("string").alias("digest"), *blank, "steps", "subroot")
    return _dealt(own.unionByName(top))


def _steps(value: list[dict]) -> list[tuple[int, list[bytes]]]:
    return [(s["slot"], [d.encode() for d in s["run"]]) for s in value]


def sunk(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """(source, pos, steps, subroot): the way to the root of every node, given that of the nodes a story higher."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (*_, higher, subroot), *rows in _blocks(batches):
            block = Block([r[4].encode() for r in rows], levels(rows[0][3], height))
            ways = [[{"slot": s, "run": [d.decode() for d in run]} for s, run in block.steps(i)] + higher
                    for i in range(len(rows))]
            yield pa.RecordBatch.from_pydict({
                "source": pa.array([rows[0][0]] * len(rows), pa.string()), "pos": [r[2] for r in rows],
                "steps": pa.array(ways, steps), "subroot": pa.array([subroot] * len(rows), pa.string())})

    steps = pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.list_(pa.string()))]))
    return _met(nodes, above, height).mapInArrow(
        per_partition, f"source string, pos long, steps {_STEPS}, subroot string")


def _down(built: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """The way to the root of every node of the lowest of these stories, given that of the nodes one above the highest."""
    for nodes in reversed(built):
        above = settle(sunk(nodes, above, height), "ways")
    return above


def manifest(
    docs: DataFrame, columns: Sequence[str], changed: dict[str, Column] | None = None, id_column: str = "doc_id",
    source_column: str = "source", height: int = HEIGHT,
) -> DataFrame:
    """One row per row of `docs`: doc_id, source, leaf, subroot, root, slots, proof, folded_root.

    leaf is the digest of the given columns. Leaves stand by id within their source (NULL first, equal ids by leaf, equal
    rows in any order) and sources by their bytes (NULL first); runs of three nodes, the last one shorter or even alone,
    become their parent until one node is left. `proof` holds the siblings' digests from the leaf's level to the root, left
    to right, and `slots` the places to put them: `slot/width` for each level. folded_root is the root that follows from
    the row with the `changed` columns (by default as it is) and the siblings of the original: it equals root exactly if
    the row is unchanged. Without rows the result is empty. Other columns of `docs` are not read.
    """
    prepare(docs.sparkSession)
    other = [(changed or {}).get(c, F.col(f"`{c}`")) for c in columns]
    leaves = settle(docs.select(
        F.col(source_column).cast("string").alias("source"), F.col(id_column).cast("long").alias("doc_id"),
        leaf([F.col(f"`{c}`") for c in columns]).alias("digest"), leaf(other).alias("claim")), "leaves")
    nodes = settle(numbered(leaves, ("doc_id", "digest")), "nodes")
    built = stories(nodes, height)
    tops = built[-1].select(F.lit(None).cast("string").alias("source"), F.col("source").alias("name"), "digest")
    sources = settle(numbered(tops, ("name",)), "nodes")
    over = stories(sources, height)
    root = over[-1].first()
    none = F.expr(f"CAST(array() AS {_STEPS})").alias("steps")
    ways = _down(over[:-1], over[-1].select("source", "pos", none, F.lit(None).cast("string").alias("subroot")), height)
    here = ways.select("pos", "steps").join(sources.select("pos", "name", "digest"), "pos")
    above = here.select(F.col("name").alias("source"), F.lit(0).cast("long").alias("pos"), "steps", F.col("digest").alias("subroot"))
    above = _down(built[1:-1], above, height)

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (*_, higher, subroot), *rows in _blocks(batches):
            block = Block([r[4].encode() for r in rows], levels(rows[0][3], height))
            way = Way(_steps(higher))
            slots, proofs, folded = [], [], []
            for i, row in enumerate(rows):
                own = block.steps(i)
                slots.append(",".join(f"{s}/{w}" for s, w in [*((s, len(run)) for s, run in own), *way.slots]))
                proofs.append(b"".join([*(d for s, run in own for k, d in enumerate(run) if k != s), way.siblings]).decode())
                folded.append(way.fold(block.fold(i, row[6].encode())).decode())
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([r[5] for r in rows], pa.int64()), "source": pa.array([r[0] for r in rows], pa.string()),
                "leaf": [r[4] for r in rows], "subroot": [subroot] * len(rows), "slots": slots, "proof": proofs,
                "folded_root": folded})

    done = _met(nodes, above, height, ("doc_id", "claim")).mapInArrow(
        per_partition, "doc_id long, source string, leaf string, subroot string, slots string, proof string, folded_root string")
    return done.withColumn("root", F.lit(root.digest if root else None).cast("string"))


def verified(digest: str, slots: str, proof: str) -> str:
    """The root that a row's digest leads to, from its proof alone, as a reader of the manifest checks it."""
    at = 0
    for step in filter(None, slots.split(",")):
        slot, width = map(int, step.split("/"))
        run = [proof[64 * k:64 * (k + 1)] for k in range(at, at + width - 1)]
        run.insert(slot, digest)
        digest, at = hashlib.sha256("".join(run).encode()).hexdigest(), at + width - 1
    return digest
