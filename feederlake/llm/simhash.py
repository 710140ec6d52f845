"""SimHash fingerprints of texts, and all pairs of fingerprints within a small Hamming distance."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feederlake.llm.common import map_batches, prepare, text_bytes, word_pieces
from feederlake.llm.components import components
from feederlake.session import settle

SEED = 42
#: From pairs (lo, hi, m, n) and what is known of each text to the pairs with the shingles they have in common.
Common = Callable[[DataFrame, DataFrame], DataFrame]


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of `width` words, repeats included; of all words if there are fewer."""
    carry: list[bytes] = []
    whole = True
    digest = xxhash.xxh64_intdigest
    for words in word_pieces(text.lower()):
        words = carry + words
        if len(words) < width:
            carry = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)
        carry, whole = words[len(words) - width + 1:], False
    if whole and carry:
        yield np.array([digest(b" ".join(carry), SEED)], dtype=np.uint64)


def _majority(hashes: np.ndarray, counts: np.ndarray) -> None:
    """Add to `counts` how many hashes have each of the 64 bits, the highest first."""
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at:at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)


def majority_bits(pieces: Iterable[np.ndarray]) -> int:
    """A bit is set if it is set in more than half of the hashes; 0 without any."""
    counts, total = np.zeros(64, dtype=np.int64), 0
    for hashes in pieces:
        _majority(hashes, counts)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprint(text: bytes, width: int) -> int:
    """The majority bits of the shingle hashes; 0 for a text without words."""
    return majority_bits(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of every row. A to Z count as a to z; NULL text counts as empty."""

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        data, bounds = text_bytes(batch.column(1))
        raw = data.tobytes()
        marks = [fingerprint(raw[a:b], width) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield {"doc_id": batch.column(0), "fingerprint": np.array(marks, dtype=np.uint64).view(np.int64)}

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return map_batches(rows, per_batch, "doc_id long, fingerprint long")


def linked_fingerprints(marks: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (lo, hi) of different fingerprints that hold every class of linked ones together.

    Meet in the middle: two fingerprints at most `radius` bits apart share a variant at most half of that away from
    both, so each emits its ball of that size and meets the others by variant. Those meeting at one variant lie in one
    ball, so there are at most 65 of them for a radius of 2 or 3; each is tied to the smallest. Distances are checked.
    """
    if radius not in (0, 1, 2):
        raise ValueError("radius must be 0, 1 or 2")
    if radius == 0:
        return marks.sparkSession.createDataFrame([], "lo long, hi long")
    ball = "explode(concat(array(fingerprint), transform(sequence(0, 63), i -> fingerprint ^ shiftleft(1L, i))))"
    if radius == 1:  # one end stays where it is
        ball = "explode(transform(sequence(0, 63), i -> fingerprint ^ shiftleft(1L, i)))"
        other = marks.select("fingerprint", F.expr(ball).alias("hi"))
        there = marks.select(F.col("fingerprint").alias("hi"))
        return other.join(there, "hi").where("fingerprint < hi").select(F.col("fingerprint").alias("lo"), "hi")
    met = marks.select("fingerprint", F.expr(ball).alias("variant"))
    met = met.withColumn("lo", F.expr("min(fingerprint) over (partition by variant)"))
    pairs = met.where("lo < fingerprint").select("lo", F.col("fingerprint").alias("hi")).distinct()
    return pairs.where(f"bit_count(lo ^ hi) <= {radius}")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, radius: int = 2
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, links.

    component_id is the smallest doc_id among the documents reachable over fingerprints at most `radius` bits apart,
    `links` the number of other fingerprints tied to this one. Texts without words (NULL, empty, blank) have the
    fingerprint 0 and are linked like any other. Repeated rows stay; a NULL doc_id keeps its row, and a class of such
    rows only has a NULL component. Other columns of `docs` are not read.

    Copies meet in their fingerprint first, so only different fingerprints are compared, however many copies there are.
    """
    marked = settle(fingerprints(docs, id_column, text_column, width), "fingerprints")
    classes = settle(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "classes")
    pairs = settle(linked_fingerprints(classes, radius), "pairs")
    part = components(pairs, "lo", "hi")
    ends = pairs.select(F.col("lo").alias("fingerprint")).unionByName(pairs.select(F.col("hi").alias("fingerprint")))
    links = ends.groupBy("fingerprint").agg(F.count("*").alias("links"))
    placed = (
        classes.join(part.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
        .withColumn("component", F.coalesce("component", "fingerprint"))
        .join(links, "fingerprint", "left")
    )
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "component").select(
        "fingerprint", "component_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    return marked.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "links")


#: A text of n different shingles keeps about n / 2 ** level of them, SAMPLE at least and twice that at most.
SAMPLE = 32
#: Share of the kept shingles that two texts have in common at least, unless all are kept.
COMMON = 0.6


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The different shingle hashes of a text, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width)]))


def level(size: int) -> int:
    """How often the shingles of a text are halved: those whose hash begins with that many zero bits are kept."""
    return max(0, (size // SAMPLE).bit_length() - 1)


def shingle_sketches(rows: DataFrame, width: int) -> DataFrame:
    """(key, s1, s2, size, level, fingerprint, kept): a 128-bit hash of the set of shingles of each text, the fingerprint
    of that set, in which a repeated shingle counts once, and the shingles kept."""

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        data, bounds = text_bytes(batch.column(1))
        raw = data.tobytes()
        marks, numbers, bits, kept = [], [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = shingle_set(raw[a:b], width)
            here = level(len(own))
            marks.append(xxhash.xxh3_128_digest(own.tobytes()))
            numbers.append((len(own), here))
            bits.append(majority_bits([own]))
            kept.append(own[:np.searchsorted(own, np.uint64(1 << 64 - here))].view(np.int64) if here else own.view(np.int64))
        halves = np.frombuffer(b"".join(marks), dtype="<i8").reshape(-1, 2)
        number = np.array(numbers, dtype=np.int64).reshape(-1, 2)
        yield {"key": batch.column(0), "s1": np.ascontiguousarray(halves[:, 0]), "s2": np.ascontiguousarray(halves[:, 1]),
               "size": np.ascontiguousarray(number[:, 0]), "level": number[:, 1].astype(np.int32),
               "fingerprint": np.array(bits, dtype=np.uint64).view(np.int64), "kept": pa.array(kept, pa.list_(pa.int64()))}

    kind = rows.schema["key"].dataType.simpleString()
    return map_batches(rows, per_batch, f"key {kind}, s1 long, s2 long, size long, level int, fingerprint long, kept array<long>")


def fingerprint_pairs(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (lo, hi) of nodes (k2, fingerprint) that hold every class of linked fingerprints together.

    Nodes with the same fingerprint are tied to the first of them, which stands for the class (see linked_fingerprints).
    """
    heads = settle(nodes.groupBy("fingerprint").agg(F.min("k2").alias("head")), "classes")
    same = nodes.join(heads, "fingerprint").where("k2 <> head").select(F.col("head").alias("lo"), F.col("k2").alias("hi"))
    linked = linked_fingerprints(heads, radius)
    near = (
        linked.join(heads.toDF("lo", "a"), "lo").join(heads.toDF("hi", "b"), "hi")
        .select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    )
    return settle(same.unionByName(near), "fingerprint-pairs")


def _in_order(entries: DataFrame, by: list[str]) -> DataFrame:
    """The entries (k2, h, ...) that another text has too, with `shared`, how many of them a text has, and `turn`, the
    place of each among them from 1, the rarest first."""
    key = [*by, "h"]
    often = entries.groupBy(*key).agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("k2", *by)
    return entries.join(often, key).withColumns(
        {"turn": F.row_number().over(own.orderBy("df", "h")), "shared": F.count("*").over(own)})


def candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """(k2) of the texts, given as (k2, size, level, kept), of whose kept shingles a share of COMMON stands in other texts.

    Where all are kept the share is `similarity`: then no text with a near copy is left out. Texts are held against
    those of their own level, and against the next one if they may have near copies there.
    """
    both = nodes.select("k2", F.col("level").alias("at"), "kept").unionByName(
        nodes.where(f"size >= {similarity}D * {SAMPLE} * shiftleft(2L, level)").selectExpr(
            "k2", "level + 1 AS at", "filter(kept, h -> shiftrightunsigned(h, 63 - level) = 0) AS kept"))
    entries = both.select("k2", "at", F.size("kept").alias("n"), F.explode("kept").alias("h"))
    often = entries.groupBy("at", "h").agg(F.count("*").alias("df")).where("df > 1").select("at", "h")
    shared = entries.join(often, ["at", "h"]).groupBy("k2", "at", "n").agg(F.count("*").alias("shared"))
    return shared.where(f"shared >= n * IF(at = 0, {similarity}D, {COMMON}D) - 1e-9D").select("k2").distinct()


def rare_places(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(place, k2, size, reach): at which shingles texts (k2, text) meet, and the largest text that each can match there.

    All shingles of a text are put in the order of their frequency, the rarest first. If the first shingle that two texts
    share comes after i others in one of them, those i are not shared, so the overlap is `size` - i at most, and the
    other text can have no more than `reach` shingles at that similarity. A text enters only where the reach is not below
    the smallest text that is similar enough by number. What a crowd shares comes last: it is met only by texts that
    hold little else, and two texts that add much of their own to it never meet.
    """

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        data, bounds = text_bytes(batch.column(1))
        raw = data.tobytes()
        found = [shingle_set(raw[a:b], width).view(np.int64)
                 for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield {"k2": batch.column(0), "shingles": pa.array(found, pa.list_(pa.int64()))}

    sets = map_batches(texts.select("k2", "text"), per_batch, "k2 long, shingles array<long>")
    entries = sets.select("k2", F.size("shingles").cast("long").alias("size"), F.explode("shingles").alias("h"))
    at = "(shared + 1 - turn)"  # size - i: the shingles from this one on
    reach = f"CAST(floor({at} * {1 + similarity}D / {similarity}D - size + 1e-6D) AS LONG)"
    return _in_order(entries, []).where(f"{at} >= {similarity}D * size - 1e-6D").select(
        F.col("h").alias("place"), "k2", "size", F.expr(reach).alias("reach"))


def shared_places(met: DataFrame) -> DataFrame:
    """(place, k2, size, reach) of the places with more than one member; places with the same members become one."""
    crowd = met.groupBy("place").agg(
        F.count("*").alias("n"), F.min("k2").alias("lo"), F.expr("bit_xor(xxhash64(k2))").alias("mark")).where("n > 1")
    one = crowd.withColumn("least", F.min("place").over(Window.partitionBy("n", "lo", "mark"))).select("place", "least")
    return met.join(one, "place").groupBy(F.col("least").alias("place"), "k2").agg(
        F.first("size").alias("size"), F.max("reach").alias("reach"))


def _common_of_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (lo, hi, m, n) with `common`, the number of shingles that both have."""
    return (
        pairs.join(sets.select(F.col("k2").alias("lo"), F.col("shingles").alias("a")), "lo")
        .join(sets.select(F.col("k2").alias("hi"), F.col("shingles").alias("b")), "hi")
        .selectExpr("lo", "hi", "m", "n", "size(array_intersect(a, b)) AS common")
    )


def common_of_texts(width: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The same from (k2, text): a text travels as it is, which is a quarter of its shingles' hashes."""

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        sets = []
        for column in (4, 5):
            data, bounds = text_bytes(batch.column(column))
            raw, last = data.tobytes(), (b"", shingle_set(b"", width))
            own = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if raw[a:b] != last[0]:  # a centre stands beside many texts
                    last = raw[a:b], shingle_set(raw[a:b], width)
                own.append(last[1])
            sets.append(own)
        common = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(*sets, strict=True)]
        yield {n: batch.column(i) for i, n in enumerate(("lo", "hi", "m", "n"))} | {"common": np.array(common, dtype=np.int64)}

    def common(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        met = (
            pairs.join(texts.select(F.col("k2").alias("lo"), F.col("text").alias("a")), "lo")
            .join(texts.select(F.col("k2").alias("hi"), F.col("text").alias("b")), "hi").select("lo", "hi", "m", "n", "a", "b")
        )
        return map_batches(met, per_batch, "lo long, hi long, m long, n long, common long")

    return common


def _distances(pairs: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: float, common: Common) -> DataFrame:
    """(lo, hi, near, nearest, farthest): whether the sets of a pair are that similar, and bounds of 1 - similarity.

    Both bounds are the distance itself, except where the numbers of shingles alone rule the similarity out.
    """
    sized = (
        pairs.join(sizes.select(F.col("k2").alias("lo"), F.col("size").alias("m")), "lo")
        .join(sizes.select(F.col("k2").alias("hi"), F.col("size").alias("n")), "hi").select("lo", "hi", "m", "n")
    )
    fit = f"least(m, n) >= {similarity}D * greatest(m, n)"
    ruled_out = sized.where(f"NOT {fit}").selectExpr(
        "lo", "hi", "false AS near", "1D - least(m, n) / greatest(m, n) AS nearest", "1D AS farthest")
    compared = (
        common(sized.where(fit), sets).withColumn("both", F.col("m") + F.col("n"))
        .selectExpr("lo", "hi", f"common >= {similarity}D * (both - common) AS near",
                    "IF(both = 0, 0D, 1D - common / (both - common)) AS nearest")
        .withColumn("farthest", F.col("nearest"))
    )
    return compared.unionByName(ruled_out)


def linked_texts(
    members: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: float, common: Common = _common_of_sets,
    known: DataFrame | None = None
) -> DataFrame:
    """(node, component) of the groups that all pairs of near copies make which can meet at a place of `members`.

    Members are (place, k2, size, reach); two of them can be near copies only if the size of each is within the reach of
    the other. Without these columns all can. In rounds: the first members of each place, one and then twice as many each
    time, are compared with all others that they can match there and that are not in their group yet, and leave. A member
    of the group of such a centre goes too where nobody of another group can be its near copy: 1 - similarity is a metric,
    so that takes somebody about as far from the centre. So does one whom nobody of another group can match by size.
    Small groups are centres first, and texts with a far reach, which have little of their own. No pair is dropped
    otherwise. Pairs that are compared already come as `known`, the result of _distances: their links count, and a place
    whose members these links join needs no comparison.
    """
    spark = members.sparkSession
    part, centres_each = spark.createDataFrame([], "node long, component long"), 1
    if known is not None:
        part = components(known.where("near"), "lo", "hi")
    if "reach" not in members.columns:
        members = members.withColumns({"size": F.lit(0).cast("long"), "reach": F.lit(0).cast("long")})
    grouped = members.join(part.toDF("k2", "part"), "k2", "left").withColumn("part", F.coalesce("part", "k2"))
    # in the first round all are compared with the centres: only who has a known distance can leave with its group
    here = settle(_open(grouped).withColumn("part", F.col("k2")), "members")
    while not here.isEmpty():
        weight = here.groupBy("place", "part").agg(F.count("*").alias("n"))
        first = Window.partitionBy("place").orderBy("n", F.col("size") - F.col("reach"), "part", "k2")
        centres = settle(
            here.join(weight, ["place", "part"]).withColumn("turn", F.row_number().over(first))
            .where(f"turn <= {centres_each}").select(
                "place", F.col("k2").alias("centre"), F.col("part").alias("own"), F.col("size").alias("c_size"),
                F.col("reach").alias("c_reach")), "centres")
        meeting = (F.col("here.place") == F.col("c.place")) & F.expr("part <> own AND size <= c_reach AND c_size <= reach")
        pairs = here.alias("here").join(centres.alias("c"), meeting).select(
            F.least("k2", "centre").alias("lo"), F.greatest("k2", "centre").alias("hi")).distinct()
        if known is not None:
            pairs = pairs.join(known, ["lo", "hi"], "left_anti")
        found = settle(_distances(pairs, sizes, sets, similarity, common), "distances")
        known = found if known is None else known.unionByName(found)
        links = found.where("near").select("lo", "hi").unionByName(part.toDF("lo", "hi"))
        part = components(links, "lo", "hi")
        rest = (
            here.join(centres.select("place", F.col("centre").alias("k2")), ["place", "k2"], "left_anti").drop("part")
            .join(part.toDF("k2", "part"), "k2", "left").withColumn("part", F.coalesce("part", "k2"))
        )
        rest = settle(_open(rest), "members")
        seen = (
            rest.join(centres.select("place", "centre"), "place").join(part.toDF("centre", "own"), "centre", "left")
            .select("place", "k2", "part", "centre", F.coalesce("own", "centre").alias("own"),
                    F.least("k2", "centre").alias("lo"), F.greatest("k2", "centre").alias("hi"))
            .join(known.drop("near"), ["lo", "hi"], "left")  # who was not compared may be anywhere
        )
        others = seen.where("part <> own").groupBy("place", "centre").agg(F.min(F.coalesce("nearest", F.lit(0.0))).alias("gap"))
        done = seen.where("part = own").join(others, ["place", "centre"], "left").where(
            f"gap IS NULL OR gap - farthest > {1 - similarity + 1e-9}D").select("place", "k2").distinct()
        here = settle(_open(rest.join(done, ["place", "k2"], "left_anti")), "members")
        centres_each *= 2
    return part


def _open(members: DataFrame) -> DataFrame:
    """The members that somebody of another group at their place can match by size."""
    groups = members.groupBy("place", "part").agg(F.min("size").alias("s"), F.max("reach").alias("r"))
    ends = groups.groupBy("place").agg(
        F.min(F.struct("s", "part")).alias("low"), F.max(F.struct("r", "part")).alias("high"), F.count("*").alias("n"))
    others = groups.join(ends.where("n > 1"), "place").groupBy("place", "low", "high").agg(
        F.expr("min(s) FILTER (WHERE part <> low.part)").alias("s2"),
        F.expr("max(r) FILTER (WHERE part <> high.part)").alias("r2"))
    return members.join(others, "place").where(
        "reach >= IF(part <> low.part, low.s, s2) AND size <= IF(part <> high.part, high.r, r2)").drop("low", "high", "s2", "r2")


def without_near_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, similarity: float = 0.8,
    radius: int = 2
) -> DataFrame:
    """The rows of `docs` without near copies: of each group the one with the smallest doc_id stays, once.

    Texts are near copies if the Jaccard similarity of their sets of `width`-word shingles is `similarity` or more. Every
    text has a fingerprint of its set; those with fingerprints at most `radius` bits apart are tied as in near_duplicates,
    and a tie counts if the whole sets are that similar. At a similarity of 0.8 most fingerprints are about ten bits
    apart, which no ball can bridge, so texts meet at their rarest shingles as well (see rare_places). Texts of up to
    2 * SAMPLE shingles keep all and surely meet. From a longer one a sample is kept, the same shingles in every text,
    and a pair at 0.8 that the fingerprints do not tie is lost with a chance below one in a hundred, less above. Those who
    meet, unless they are in one group by their fingerprints, are compared by their whole sets of shingles in rounds (see
    linked_texts), unless their sizes alone rule the similarity out; groups are connected components.

    Equal sets of shingles are one node. NULL text counts as empty; rows without words are copies of each other. A NULL
    doc_id counts as larger than any other. All columns of `docs` are returned, whatever their names.
    """
    prepare(docs.sparkSession)
    plain = F.coalesce(F.col(text_column), F.lit(""))
    key = F.struct(F.coalesce(F.col(id_column).cast("long"), F.lit((1 << 63) - 1)).alias("k1"),
                   F.xxhash64(plain).alias("t1"), F.xxhash64(F.lit(1), plain).alias("t2")).alias("key")
    rows = docs.select(key, plain.alias("text"))
    nodes = shingle_sketches(rows, width).groupBy("s1", "s2").agg(
        F.min("key").alias("key"), *(F.first(c).alias(c) for c in ("size", "level", "fingerprint", "kept")))
    nodes = settle(nodes.drop("s1", "s2").withColumn("k2", F.monotonically_increasing_id()), "nodes")
    sizes, common = nodes.select("k2", "size"), common_of_texts(width)
    tied = fingerprint_pairs(nodes.select("k2", "fingerprint"), radius)
    ends = tied.select(F.explode(F.array("lo", "hi")).alias("k2"))
    met = nodes.join(candidates(nodes, similarity).unionByName(ends), "k2", "left_semi").select("key", "k2")
    texts = settle(rows.join(met, "key").select("k2", "text").dropDuplicates(["k2"]), "texts")
    checked = settle(_distances(tied, sizes, texts, similarity, common), "distances")
    members = settle(shared_places(rare_places(texts, width, similarity)), "places")
    part = linked_texts(members, sizes, texts, similarity, common, checked)
    kept = (
        nodes.select("k2", "key").join(part.withColumnRenamed("node", "k2"), "k2", "left")
        .groupBy(F.coalesce("component", "k2").alias("component")).agg(F.min("key").alias("key")).select("key")
    )
    held = docs.select(F.struct("*").alias("row"), key).join(kept, "key", "left_semi")
    return held.dropDuplicates(["key"]).select("row.*")
