"""Near-dedup by shingle similarity: every pair of texts whose sets of shingles have a Jaccard similarity of 0.8 or more.

A text is its set of hashed shingles (as in ``simhash``: ASCII-lower-cased words, ``words`` words each;
a text of fewer words is one shingle, one without words has none). Equal sets are one node.
Similar sets share at least ``SIMILARITY`` of the larger one, so of two of them the smallest
fifth of the hashes (and one) hold a common one: these are the set's blocks, and every
similar pair meets in one. Those that meet are told apart by their sizes and by how
far up the common hash stands in each: what comes before the first common hash is in one set only.
Then by their sketches, the parities of a set's hashes in about one and a half slots a hash: a hash that
only one set has changes one parity, so sets whose sketches differ in more than similar sets may have apart
are not similar. What is left is verified on the sets themselves. Both go by shares of the pairs, so that the sketches and texts
that travel at a time are never many times those of the nodes. In crowded blocks every node is first
linked to the smallest one. Nothing is capped.

Before that, texts are linked whose SimHash fingerprints (as ``simhash`` makes and finds them) differ in
few bits; sets that these links have grouped are not compared any more. Groups are those of both kinds of links.

Edge cases: null text is an empty text; texts without words are one group; a null doc_id, repeated
rows, an empty table and other columns are treated as by ``simhash.keep_first``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.llm import simhash
from gridcast.llm.common import byte_texts, components, parts, release, row_hash, scratch, stage, thinned
from gridcast.llm.simhash import SEED, keep_leaders

SIMILARITY = 0.8
#: Nodes from which on a block counts as crowded.
CROWD = 24
#: Pairs a node whose sketches travel at a time.
PAIRS_A_NODE = 8
#: Slots of the smallest sketch; others have a power of two.
SLOTS = 64
SETS = "doc_id long, row long, print long, size int, blocks array<long>, sketch binary"


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The hashes of a text's shingles, each once and in their order."""
    found = text.lower().split() if text else []
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - words + 1].tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], dtype=np.uint64))


def taken(size: int) -> int:
    """How many of a set's hashes are its blocks."""
    return size - int(np.ceil(SIMILARITY * size - 1e-9)) + 1 if size else 0


def sketch(hashes: np.ndarray) -> bytes:
    """Whether an odd number of the hashes falls on each slot."""
    slots = SLOTS
    while slots < 1.5 * len(hashes):
        slots *= 2
    odd = np.bincount((hashes & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def odd_slots(left: pa.Array, right: pa.Array) -> np.ndarray:
    """In how many slots the sketches of each pair differ; the longer one is folded to the slots of the other."""
    sizes = np.stack([pc.binary_length(x).to_numpy() for x in (left, right)], axis=1)
    found = np.zeros(len(sizes), dtype=np.int64)
    for pair in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == pair).all(axis=1))
        a, b = (np.frombuffer(b"".join(x.take(pa.array(at)).to_pylist()), dtype=np.uint8).reshape(len(at), -1) for x in (left, right))
        while a.shape[1] != b.shape[1]:
            half = max(a.shape[1], b.shape[1]) // 2
            a, b = (x[:, :half] ^ x[:, half:] if x.shape[1] > half else x for x in (a, b))
        found[at] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return found


def sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, row, print, size, blocks, sketch), one row a row of ``docs``; print names the set."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            prints, sizes, blocks, sketches = [], [], [], []
            for text in byte_texts(batch, "text"):
                found = shingles(text, words)
                prints.append(xxhash.xxh3_64_intdigest(found.tobytes()))
                sizes.append(len(found))
                blocks.append(found[: taken(len(found))].view(np.int64))
                sketches.append(sketch(found))
            offsets = np.append(0, np.cumsum([len(b) for b in blocks]))
            arrays = [
                batch.column("doc_id"),
                batch.column("row"),
                pa.array(np.array(prints, dtype=np.uint64).view(np.int64), pa.int64()),
                pa.array(sizes, pa.int32()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*blocks, np.zeros(0, np.int64)]), pa.int64())),
                pa.array(sketches, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SETS.split(", ")])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_hash().alias("row"))
    return read.mapInArrow(per_batch, SETS)


def meetings(found: DataFrame) -> DataFrame:
    """(block, print, size, place, n, leader): nodes in blocks that others are in, their number and the smallest of them."""
    placed = found.select("print", "size", F.posexplode("blocks").alias("place", "block"))
    shared = stage(placed.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block"))
    held = stage(thinned(placed, shared, "block").distinct())
    release(found.sparkSession)
    crowds = held.groupBy("block").agg(F.count("*").alias("n"), F.min("print").alias("leader")).where("n > 1")
    return stage(held.join(crowds, "block"))


def near() -> Column:
    """Whether two sets may be similar if no smaller hash than the one they meet in is common."""
    least = F.ceil((F.col("size") + F.col("o_size")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9)
    return F.least(F.col("size") - F.col("place"), F.col("o_size") - F.col("o_place")) >= least


def leader_pairs(met: DataFrame) -> DataFrame:
    """(a, b): in blocks of many nodes, the smallest node with every node that may be near it."""
    crowded = met.where(F.col("n") >= CROWD)
    led = crowded.where("print = leader").select("block", F.col("print").alias("a"), F.col("size").alias("o_size"), F.col("place").alias("o_place"))
    return crowded.where("print != leader").join(led, "block").where(near()).select("a", F.col("print").alias("b")).distinct()


def candidates(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): nodes of one block that may be near each other, unless they have the same root already."""
    placed = met.join(roots, "print", "left").select("block", "print", "size", "place", F.coalesce("root", "print").alias("root"))
    other = placed.select(*[F.col(c).alias(f"o_{c}") for c in placed.columns])
    apart = (F.col("print") < F.col("o_print")) & (F.col("root") != F.col("o_root"))
    found = placed.join(other, (F.col("block") == F.col("o_block")) & apart & near())
    return found.select(F.col("print").alias("a"), F.col("o_print").alias("b")).distinct()


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches let their sets be similar."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = odd_slots(batch.column("a_sketch"), batch.column("b_sketch"))
            most = (batch.column("a_size").to_numpy() + batch.column("b_size").to_numpy()) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6
            yield batch.select(["a", "b"]).filter(pa.array(apart <= most, pa.bool_()))

    # Written numbers that repeat take a tenth of what they take in memory; the hint keeps pairs from being broadcast.
    for side in ("a", "b"):
        named = nodes.select(F.col("print").alias(side), F.col("size").alias(f"{side}_size"), F.col("sketch").alias(f"{side}_sketch"))
        pairs = pairs.hint("merge").join(named, side)
    return pairs.mapInArrow(per_batch, "a long, b long")


def in_shares(pairs: DataFrame, most: int, function: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``function`` gives for all pairs, staged for about ``most`` of them at a time, so that only a share's shuffles are on disk."""
    shares = max(1, -(-pairs.count() // max(most, 1)))
    found = []
    for share in range(shares):
        found.append(stage(function(pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(shares)) == share))))
        release(pairs.sparkSession)
    return functools.reduce(DataFrame.unionByName, found)


def edges_of(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The pairs whose sets are similar enough."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                keep = []
                for left, right in zip(byte_texts(part, "left"), byte_texts(part, "right")):
                    a, b = shingles(left, words), shingles(right, words)
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(common >= SIMILARITY * (len(a) + len(b) - common) - 1e-9)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = stage(pairs)
    release(docs.sparkSession)
    pairs = in_shares(pairs, PAIRS_A_NODE * nodes.count(), lambda some: likely(some, nodes))
    named = pairs.select(F.col("a").alias("print")).unionByName(pairs.select(F.col("b").alias("print"))).distinct()
    wanted = stage(nodes.join(named, "print").select("print", "row"))
    read = docs.select(F.col("text").cast("string").alias("text"), row_hash().alias("row"))
    # Rows that repeat a document have the same text.
    texts = stage(thinned(read, wanted, "row").join(wanted.hint("shuffle_hash"), "row").groupBy("print").agg(F.first("text").alias("text")))
    left = texts.select(F.col("print").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("print").alias("b"), F.col("text").alias("right"))

    def compared(some: DataFrame) -> DataFrame:
        joined = some.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "left", "right")
        return joined.mapInArrow(per_batch, "a long, b long")

    # A share ships about as many texts as there are nodes.
    return in_shares(pairs, texts.count(), compared)


def fingerprint_links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): sets of texts whose fingerprints are in one group, each with the smallest one of its group."""
    prints = stage(simhash.fingerprints(docs).select("doc_id", "row", "print"))
    # Numbers of all rows: their files are small enough to be broadcast long after they are too many for it.
    marks = prints.select("row", "print").distinct().hint("merge").join(simhash.grouped(prints).select("print", "root"), "print").select("row", "root")
    placed = stage(marks.hint("merge").join(found.select("row", "print").distinct(), "row").select("root", "print").distinct())
    first = placed.groupBy("root").agg(F.min("print").alias("a"))
    return stage(placed.join(first, "root").where("a != print").select("a", F.col("print").alias("b")))


def ungrouped(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose sets have not the same ``root`` yet."""
    for side in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("print").alias(side), F.col("root").alias(f"{side}_root")), side, "left")
    return pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def labelled(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, row, print, component_id) for every row of ``docs``."""
    found = stage(sets(docs, words))
    nodes = stage(found.groupBy("print").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("size", "sketch")]))
    met = meetings(found)
    edges = fingerprint_links(docs, found)
    led = ungrouped(leader_pairs(met), components(edges).withColumnRenamed("node", "print"))
    edges = edges.unionByName(edges_of(docs, nodes, led, words))
    edges = edges.unionByName(edges_of(docs, nodes, candidates(met, components(edges).withColumnRenamed("node", "print")), words))
    roots = components(edges).withColumnRenamed("node", "print")
    rooted = nodes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("print", "root", "component_id")
    return found.select("doc_id", "row", "print").join(named, "print").select("doc_id", "row", F.col("root").alias("print"), "component_id")


def keep_first(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``docs`` that lead their component, as ``simhash.keep_first`` chooses them; all columns kept."""
    with scratch(docs.sparkSession):
        found = stage(labelled(docs, words), lasting=True)
    return keep_leaders(docs, found)
