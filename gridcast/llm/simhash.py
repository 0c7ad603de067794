"""SimHash near-dedup by anchor-point covering.

Fingerprint: ASCII-lower-cased words, shingles of ``words`` words (repeats
included), XXH64 with seed 42 of each; a bit is set if it is set in over half
of the hashes. A text of fewer words is one shingle; a text without words has
fingerprint zero.

Two fingerprints link at 4 or fewer differing bits. The 64 bits are cut into
five parts, A to E. If A and B together differ in at most one bit, table AB
sees the pair; else A and B hold two of the at most four differences, C, D and E hold at
most two, and two of them hold at most one together. So in one of the tables
AB, CD, CE and DE the pair differs in at most one bit (threshold 1). The anchors of a
table are the words of a covering code on its bits: a Hamming(7,4) code times
all words of the remaining bits, with covering radius 1. Every fingerprint has a home
anchor, its nearest one, and is replicated to every anchor within covering
radius plus threshold (about 20 a table); a pair meets at the home anchor of
either of the two. Fingerprints that meet are compared in full. Nothing is
capped: the covering guarantees every link.

Equal fingerprints are grouped first, so copies cost one row. Links are reduced
to components by star contraction; a document's component is the smallest
doc_id that it can reach.

Edge cases: null text is an empty text; a null doc_id keeps its row and never
names a component (a component with null ids only is null); rows that repeat a
doc_id are rows of their own; an empty table gives an empty result; other
columns are not read by ``near_duplicates`` and are kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.common import byte_texts, components, row_hash, stage, unused

BITS = 4
PARTS = (13, 13, 13, 13, 12)
TABLES = ((0, 1), (2, 3), (2, 4), (3, 4))
SEED = 42
#: Shingles whose bits are summed at a time.
SUMMED = 1 << 16


def fingerprint(text: bytes | None, words: int) -> int:
    parts = text.lower().split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), SUMMED):
        bits = np.unpackbits(hashes[i : i + SUMMED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, row hash, fingerprint as a signed long), one row a row of ``docs``."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in byte_texts(batch, "text")], dtype=np.uint64)
            arrays = [batch.column("doc_id"), batch.column("row"), pa.array(found.view(np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row", "print"])

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("row", row_hash())
    return read.mapInArrow(per_batch, "doc_id long, row long, print long")


def hamming_words() -> np.ndarray:
    """The 16 words of the Hamming(7,4) code: bits whose positions (1 to 7) sum to zero in binary."""
    return np.array([w for w in range(128) if not np.bitwise_xor.reduce([i + 1 for i in range(7) if w >> i & 1] or [0])], dtype=np.int64)


def anchor_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """For each 7-bit word: its nearest code word, and its code words by their distance."""
    code = hamming_words()
    apart = np.bitwise_count(np.arange(128, dtype=np.int64)[:, None] ^ code[None, :])
    home = code[apart.argmin(axis=1)]
    return home, [apart <= d for d in range(8)]


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row index, key (table and anchor) and whether it is the home anchor, for all anchors of all fingerprints."""
    home, within = anchor_tables()
    code = hamming_words()
    prints = prints.view(np.uint64)
    starts = np.concatenate([[0], np.cumsum(PARTS)])
    rows = np.arange(len(prints))
    out_rows, out_keys, out_home = [], [], []

    def add(index, number, anchor, is_home):
        out_rows.append(index)
        out_keys.append((np.int64(number) << np.int64(32)) | anchor)
        out_home.append(np.full(len(index), is_home))

    for number, (a, b) in enumerate(TABLES):
        part = lambda i: ((prints >> np.uint64(starts[i])) & np.uint64((1 << PARTS[i]) - 1)).astype(np.int64)
        value = part(a) | (part(b) << np.int64(PARTS[a]))
        free_bits = PARTS[a] + PARTS[b] - 7
        low, free = value & 127, value >> 7
        mine = home[low]
        add(rows, number, mine | (free << 7), True)
        # Covering radius 1 plus threshold 1: code words within 2 on the same free bits ...
        at, word = np.nonzero(within[2][low])
        other = code[word] != mine[at]
        add(at[other], number, code[word][other] | (free[at][other] << 7), False)
        # ... or within 1 when one free bit differs.
        at, word = np.nonzero(within[1][low])
        for bit in range(free_bits):
            add(at, number, code[word] | ((free[at] ^ (1 << bit)) << 7), False)
    return np.concatenate(out_rows), np.concatenate(out_keys), np.concatenate(out_home)


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): different fingerprints of column ``print`` that differ in at most ``bits`` (4 at most) bits."""
    if bits > BITS:
        raise ValueError(f"The covering holds for at most {BITS} bits.")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                values = batch.column("print").slice(i, 4096).to_numpy()
                rows, keys, is_home = anchors(values)
                arrays = [pa.array(keys, pa.int64()), pa.array(values[rows], pa.int64()), pa.array(is_home, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "print", "home"])

    placed = prints.select("print").mapInArrow(per_batch, "anchor long, print long, home boolean")
    # Anchors look as small to Spark as the fingerprints they came from (some 90 rows each); the hint keeps them from being broadcast.
    homes = placed.where("home").select("anchor", F.col("print").alias("a")).hint("merge")
    others = placed.select("anchor", F.col("print").alias("b")).hint("merge")
    met = homes.join(others, "anchor").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).where("a < b")
    return met.select("a", "b").distinct()


def grouped(found: DataFrame, bits: int = BITS) -> DataFrame:
    """(print, first, root) of every fingerprint: its smallest doc_id and the smallest fingerprint it can reach."""
    distinct = stage(found.groupBy("print").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct, bits)).withColumnRenamed("node", "print")
    return distinct.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))


def labelled(docs: DataFrame, words: int = 4, bits: int = BITS) -> DataFrame:
    """(doc_id, row, print, component_id) for every row of ``docs``."""
    found = stage(fingerprints(docs, words))
    rooted = grouped(found, bits)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("print", "component_id")
    return found.join(named, "print").select("doc_id", "row", "print", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprint as 16 hex digits."""
    found = labelled(docs, words, bits)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 4, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that lead their component, all columns kept.

    The leader is the row with the component's smallest doc_id; of rows that
    repeat this doc_id the one with the smallest row hash stays. Rows without a
    doc_id stay only if no row of their component has one, and then one for each fingerprint.
    """
    return keep_leaders(docs, labelled(docs, words, bits))


def keep_leaders(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that lead their component in ``found``, as ``labelled`` gives it."""
    leading = found.where(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    # A group is a component, or a fingerprint where no row of the component has a doc_id.
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("print"))]
    row, place = unused(docs, "_row"), unused(docs, "_place")
    kept = leading.groupBy(*group).agg(F.min("row").alias(row)).select(row).distinct()
    named = docs.withColumn(row, row_hash()).join(kept, row)
    # Repeated rows are equal in doc_id and text; the join has brought them together.
    numbered = named.withColumn(place, F.row_number().over(Window.partitionBy(row).orderBy(F.lit(0))))
    return numbered.where(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
