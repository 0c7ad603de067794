"""Line dedup over fuzzy lines: pigeonhole on word pairs, edit similarity, one occurrence a group.

A line is normalised to its lower-case words; lines under ``LEAST_WORDS`` words
are too short for a fuzzy comparison; they stay, or with ``short`` are compared as a whole. Equal normalised lines are one
node, named by a 64-bit digest. Similar lines have a word edit distance of at most
a fifth of the longer one's words (similarity 0.8). An edit breaks at most two of a line's pairs of
neighbouring words, so two similar lines share all but twice that many. All lines
order their pairs alike, those of rare words first (by counts over all documents; any order
is right, this one meets few strangers). Of two lines that share so many pairs, the first few in that order
(two a possible edit, and one) hold a common one: these are the line's blocks, and
every similar pair meets in one of them. Those that meet are told apart by the parities of their
words in 128 slots: an edit changes two at most. Between lines of ``LONG`` words and more, which
fill so few slots evenly, 512 slots decide as well. What is left is verified by word edit
distance, links are reduced to connected groups, and of
every group the first occurrence in the order of doc_id, row and line stays. Nothing is capped.

Hot lines are counted before they are shuffled and cost one node; only distinct lines have blocks. Joins back to
their places can be split by adaptive execution. Only lines with a candidate
travel as text.

Edge cases: null and empty texts have no lines; a null doc_id comes last in the
order; rows equal in doc_id and text count as one document; documents whose lines
all go stay with an empty text; an empty table gives an empty result; other
columns are kept by ``drop_lines``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm.common import WORD_BYTES, byte_texts, components, group_bounds, parts, release, row_hash, scratch, stage, thinned, unused, words_of
from gridcast.llm.edits import bounded

SIMILARITY = 0.8
LEAST_WORDS = 5
#: Slots that words are counted in, and those of a piece of the counts.
SLOT_BITS, PIECE_BITS = 20, 14
#: Bits of a block's name; strangers that share a name are told apart as any others in a block.
BLOCK_BITS, BLOCK_BYTES = 40, 5
#: Bits beside a block's name for a line's number of words.
WORD_BITS = 64 - BLOCK_BITS
#: Lines whose pairs are sorted at a time, and bits of a pair's hash there; the level has what is left.
LINE_BITS, PAIR_BITS = 13, 42
#: Shares that blocks are dealt with in.
ROUNDS = 4
NAMED = [f"blocks_{r}" for r in range(ROUNDS)]
#: Words from which on a line has the wide sketch, and its columns.
LONG = 96
WIDE = [f"wide_{i}" for i in range(8)]
LINES = ", ".join(["key long, words int, high long, low long", *[f"{c} binary" for c in NAMED], *[f"{c} long" for c in WIDE], "doc_id long, row long, line int"])
#: ``WORD_BYTES`` that leaves line ends as they are, and as a table of words' bytes only.
LINE_BYTES = WORD_BYTES[:10] + b"\n" + WORD_BYTES[11:]
#: Kinds of rows that blocks give.
PAIR, LED, CROWDED = 0, 1, 2
MET = "kind int, a long, b long, words int, high long, low long"
#: Nodes from which on a block counts as crowded.
CROWD = 24
#: Odd factors that mix hashes.
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: The bytes of a number that a word of so many bytes fills.
FILLED = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
#: Bytes from which on a word is hashed by itself.
LONG_WORD = 64


def edits_allowed(words):
    """Edits between similar lines of which the longer has so many words."""
    return np.floor((1 - SIMILARITY) * np.asarray(words) + 1e-9).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * STEP
    return x ^ (x >> np.uint64(32))


def hashes_at(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64 bits for each of the words that lie in ``data``, which ends with eight bytes of no word."""
    eights = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    found = mixed(eights[starts] & FILLED[np.minimum(lengths, 8)] ^ lengths.astype(np.uint64) * STEP)
    longer = np.flatnonzero(lengths > 8)
    for i in range(8, LONG_WORD, 8):
        longer = longer[lengths[longer] > i]
        if not len(longer):
            return found
        more = eights[starts[longer] + i] & FILLED[np.minimum(lengths[longer] - i, 8)]
        found[longer] = mixed(found[longer] * MIX ^ more)
    for i in longer[lengths[longer] > LONG_WORD]:
        found[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lengths[i]])
    return found


def hashes_of(words: Sequence[bytes]) -> np.ndarray:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return hashes_at(b"".join(words) + bytes(8), np.cumsum(lengths) - lengths, lengths)


def hashed_lines(texts: Sequence[bytes | None], least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines of at least so many words: hashes of their words one after another, words a line, text and number of the line in it."""
    data = b" " + b"\n".join([t or b"" for t in texts]).translate(LINE_BYTES) + b" " * 8
    bytes_ = np.frombuffer(data, dtype=np.uint8)
    inside = bytes_ > 32
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, lengths = turns[::2], turns[1::2] - turns[::2]
    ends = np.append(np.searchsorted(starts, np.flatnonzero(bytes_ == 10)), len(starts))
    sizes = np.diff(ends, prepend=0)
    every = np.fromiter((t.count(b"\n") + 1 if t else 1 for t in texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts)), every)
    number = np.arange(len(sizes)) - np.repeat(np.cumsum(every) - every, every)
    kept = sizes >= max(least, 1)
    if not kept.all():
        of_kept = np.repeat(kept, sizes)
        starts, lengths = starts[of_kept], lengths[of_kept]
    at = np.flatnonzero(kept)
    return hashes_at(data, starts, lengths), sizes[at], text[at], number[at]


def digests(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits a line, from its words in their order."""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    firsts = np.cumsum(sizes) - sizes
    place = (np.arange(len(hashes)) - np.repeat(firsts, sizes)).astype(np.uint64)
    return mixed(np.add.reduceat(mixed(hashes + place * MIX), firsts) + sizes.astype(np.uint64)).view(np.int64)


def word_levels(docs: DataFrame) -> np.ndarray:
    """A level for each slot of word hashes, eight to the doubling of its words in all documents."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for batch in parts(batches):
            hashes = hashed_lines(byte_texts(batch, "text"))[0]
            counts += np.bincount((hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(counts))
        pieces = counts.reshape(-1, 1 << PIECE_BITS)
        used = np.flatnonzero(pieces.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([pieces[i].tobytes() for i in used], pa.binary())], names=["piece", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist()):
                totals[piece] = totals.get(piece, 0) + np.frombuffer(counts, dtype=np.int64)
        levels = [np.minimum(8 * np.log2(1.0 + n), 255).astype(np.uint8).tobytes() for n in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(levels, pa.binary())], names=["piece", "counts"])

    schema = "piece int, counts binary"
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(per_task, schema).repartition("piece").mapInArrow(summed, schema).toArrow()
    levels = np.zeros((1 << (SLOT_BITS - PIECE_BITS), 1 << PIECE_BITS), dtype=np.uint8)
    for piece, found in zip(counted.column("piece").to_pylist(), counted.column("counts").to_pylist()):
        levels[piece] = np.frombuffer(found, dtype=np.uint8)
    return levels.ravel()


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits a line (two signed longs): whether an odd number of its words falls on each."""
    if not len(sizes):
        return np.zeros((0, 2), dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    bit = np.uint64(1) << (hashes & np.uint64(63))
    half = hashes >> np.uint64(6) & np.uint64(1)
    return np.stack([np.bitwise_xor.reduceat(np.where(half == i, bit, np.uint64(0)), starts) for i in range(2)], axis=1).view(np.int64)


def wide_sketches(hashes: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
    """The same in 512 bits (eight longs) for lines of ``LONG`` words and more, nulls for others."""
    long = sizes >= LONG
    hashes = hashes[np.repeat(long, sizes)]
    found = np.zeros((len(WIDE), len(sizes)), dtype=np.uint64)
    if len(hashes):
        starts = np.cumsum(sizes[long]) - sizes[long]
        bit, eighth = np.uint64(1) << (hashes & np.uint64(63)), hashes >> np.uint64(6) & np.uint64(7)
        for i in range(len(WIDE)):
            found[i, long] = np.bitwise_xor.reduceat(np.where(eighth == np.uint64(i), bit, np.uint64(0)), starts)
    return [pa.array(x.view(np.int64), pa.int64(), mask=~long) for x in found]


def blocks_of(hashes: np.ndarray, sizes: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of all lines one after another, and how many each line has.

    Lines of n and m >= n words that are similar share m - 1 - 2 e pairs at least, e being the
    edits allowed at m. So the first 2 e + 1 pairs of the longer and the first n - m + 2 e + 1 of the
    shorter have one in common; the latter is most for m = n or n + 1.
    """
    taken = np.minimum(np.maximum(2 * edits_allowed(sizes) + 1, 2 * edits_allowed(sizes + 1)), sizes - 1)
    taken[sizes < LEAST_WORDS] = 0
    ends = np.cumsum(sizes)
    level = levels[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64)
    found = [np.zeros(0, dtype=np.uint64)]
    for i in range(0, len(sizes), 1 << LINE_BITS):
        some = slice(i, i + (1 << LINE_BITS))
        words = slice(int(ends[i] - sizes[i]), int(ends[some][-1]))
        inner = np.ones(words.stop - words.start, dtype=bool)
        inner[ends[some] - 1 - words.start] = False
        at = np.flatnonzero(inner) + words.start
        pairs = hashes[at] * MIX + hashes[at + 1]
        pairs = (pairs ^ (pairs >> np.uint64(32))) * MIX
        each = sizes[some] - 1
        line = np.repeat(np.arange(len(each), dtype=np.uint64), each)
        # Line, level and hash in one number, so that one sort puts every line's pairs in their order.
        value = line << np.uint64(64 - LINE_BITS) | (level[at] + level[at + 1]) << np.uint64(PAIR_BITS) | pairs >> np.uint64(64 - PAIR_BITS)
        value.sort()
        index = np.arange(len(value))
        new = np.ones(len(value), dtype=bool)
        new[1:] = value[1:] != value[:-1]
        # A pair that a line repeats is another one each time.
        again = index - np.maximum.accumulate(np.where(new, index, 0))
        held = index - np.repeat(np.cumsum(each) - each, each) < np.repeat(taken[some], each)
        names = ((value[held] & np.uint64((1 << (64 - LINE_BITS)) - 1)) + again[held].astype(np.uint64) * STEP) * MIX
        found.append(names >> np.uint64(64 - BLOCK_BITS))
    return np.concatenate(found), taken


def packed(blocks: np.ndarray) -> np.ndarray:
    """The bytes of the blocks' names, ``BLOCK_BYTES`` each."""
    return np.ascontiguousarray(blocks.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BLOCK_BYTES]).ravel()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // BLOCK_BYTES, 8), dtype=np.uint8)
    wide[:, :BLOCK_BYTES] = np.frombuffer(data, dtype=np.uint8).reshape(-1, BLOCK_BYTES)
    return wide.view("<u8").ravel()


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array whose items take so many of the bytes each."""
    offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def line_table(docs: DataFrame, short: bool = False) -> DataFrame:
    """(key, words, high, low, doc_id, row, line) and the blocks by shares of every line that is long enough, with ``short`` of every line with a word."""
    least = 1 if short else LEAST_WORDS
    levels = word_levels(docs)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 256):
            hashed, sized, text, number = hashed_lines(byte_texts(batch, "text"), least)
            rows = pa.array(text, pa.int64())
            bits = sketches(hashed, sized)
            blocks, taken = blocks_of(hashed, sized, levels)
            share, line = blocks % np.uint64(ROUNDS), np.repeat(np.arange(len(taken)), taken)
            shares = [binaries(packed(blocks[share == r]), np.bincount(line[share == r], minlength=len(taken)) * BLOCK_BYTES) for r in range(ROUNDS)]
            arrays = [
                pa.array(digests(hashed, sized), pa.int64()),
                pa.array(sized, pa.int32()),
                pa.array(np.ascontiguousarray(bits[:, 0]), pa.int64()),
                pa.array(np.ascontiguousarray(bits[:, 1]), pa.int64()),
                *shares,
                *wide_sketches(hashed, sized),
                batch.column("doc_id").take(rows),
                batch.column("row").take(rows),
                pa.array(number, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in LINES.split(", ")])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_hash().alias("row"))
    return read.mapInArrow(per_batch, LINES)


def near_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words of rows (block and words, key, high, low) let them be similar, as ``near`` tells it."""
    words, others = ((x[:, 0] & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64) for x in (a, b))
    apart = np.bitwise_count(a[:, 2] ^ b[:, 2]).astype(np.int64) + np.bitwise_count(a[:, 3] ^ b[:, 3])
    longer = np.abs(words - others)
    most = edits_allowed(np.maximum(words, others))
    return (longer <= most) & (apart <= 2 * most - longer) & (a[:, 1] != b[:, 1])


def met_rows(kind: int, a: np.ndarray, b: np.ndarray, rows: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(a)
    more = [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.int64())]
    if rows is not None:
        words = (rows[:, 0] & np.uint64((1 << WORD_BITS) - 1)).astype(np.int32)
        more = [pa.array(words), *(pa.array(np.ascontiguousarray(rows[:, i]).view(np.int64)) for i in (2, 3))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, dtype=np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *more], names=[x.split()[0] for x in MET.split(", ")])


def meet(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What all rows of some blocks give: near pairs of small blocks, near pairs of a crowd's smallest node, and crowds."""
    if not len(rows):
        return
    blocks = rows[:, 0] >> np.uint64(WORD_BITS)
    order = np.argsort(blocks)
    blocks = blocks[order]
    same = blocks[1:] == blocks[:-1]
    shared = np.append(False, same) | np.append(same, False)
    rows = rows[order[shared]]
    # A line that several tasks hold counts once.
    rows = rows[np.lexsort((np.ascontiguousarray(rows[:, 1]).view(np.int64), rows[:, 0]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
    rows = rows[new]
    blocks = rows[:, 0] >> np.uint64(WORD_BITS)
    if not len(rows):
        return
    starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
    counts = np.diff(np.append(starts, len(blocks)))
    crowded = np.repeat(counts >= CROWD, counts)
    small, names = rows[~crowded], blocks[~crowded]
    for apart in range(1, CROWD - 1):
        at = np.flatnonzero(names[apart:] == names[:-apart])
        if not len(at):
            break
        for i in range(0, len(at), 1 << 18):
            some = at[i : i + (1 << 18)]
            left, right = small[some], small[some + apart]
            close = near_pairs(left, right)
            a, b = (np.ascontiguousarray(x[close, 1]).view(np.int64) for x in (left, right))
            if len(a):
                yield met_rows(PAIR, np.minimum(a, b), np.maximum(a, b))
    if not crowded.any():
        return
    rows, blocks = rows[crowded], blocks[crowded]
    order = np.lexsort((np.ascontiguousarray(rows[:, 1]).view(np.int64), blocks))
    rows, blocks = rows[order], blocks[order]
    counts = counts[counts >= CROWD]
    leaders = np.repeat(np.cumsum(counts) - counts, counts)
    for i in range(0, len(rows), 1 << 16):
        some = slice(i, i + (1 << 16))
        led = rows[leaders[some]]
        close = near_pairs(led, rows[some])
        keys, firsts = (np.ascontiguousarray(x[:, 1]).view(np.int64) for x in (rows[some], led))
        yield met_rows(LED, firsts[close], keys[close])
        yield met_rows(CROWDED, keys, blocks[some].astype(np.int64), rows[some])


def meetings(lines: DataFrame) -> DataFrame:
    """(kind, a, b, words, high, low): what lines give that are in one block.

    ``PAIR``: a and b are near and in a block of few nodes; ``LED``: a is the smallest node of a crowded
    block and b is near it; ``CROWDED``: node a is in the crowded block b. A task sends a line that
    it holds several times once, and what several tasks send counts once, so that a block counts distinct
    lines and a hot line is at most as many rows as there are tasks.
    Blocks are dealt with in ``ROUNDS`` shares by their names, so that only a share of them is on
    disk at a time; they travel as packed numbers with the sketches, many to a row.
    """
    spark = lines.sparkSession
    pieces = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, at = np.unique(batch.column("key").to_numpy(), return_index=True)
            at = at[np.fromiter((k not in seen for k in keys.tolist()), bool, len(keys))]
            seen.update(keys.tolist())
            batch = batch.take(pa.array(np.sort(at)))
            counts = pc.binary_length(batch.column("blocks")).to_numpy() // BLOCK_BYTES
            names = unpacked(b"".join(batch.column("blocks").to_pylist()))
            line = np.repeat(np.arange(len(counts)), counts)
            piece = (names // np.uint64(ROUNDS) % np.uint64(pieces)).astype(np.uint32)
            order = np.argsort(piece, kind="stable")
            line, names, piece = line[order], names[order], piece[order]
            rows = np.empty((len(names), 4), dtype=np.uint64)
            rows[:, 0] = names << np.uint64(WORD_BITS) | batch.column("words").to_numpy().astype(np.uint64)[line]
            for i, c in enumerate(("key", "high", "low"), 1):
                rows[:, i] = batch.column(c).to_numpy().view(np.uint64)[line]
            starts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])) if len(piece) else np.zeros(0, dtype=np.int64)
            counts = np.diff(np.append(starts, len(piece)))
            yield pa.RecordBatch.from_arrays([pa.array(piece[starts].astype(np.int32)), binaries(rows.ravel().view(np.uint8), counts * 32)], names=["piece", "data"])

    def per_share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [b"".join(batch.column("data").to_pylist()) for batch in batches]
        yield from meet(np.frombuffer(b"".join(data), dtype=np.uint64).reshape(-1, 4))

    found = []
    for name in NAMED:
        share = lines.select("key", "words", "high", "low", F.col(name).alias("blocks")).where(F.length("blocks") > 0)
        found.append(stage(share.mapInArrow(per_task, "piece int, data binary").repartition("piece").mapInArrow(per_share, MET)))
        release(spark)
    return functools.reduce(DataFrame.unionByName, found)


def as_other(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"o_{c}") for c in columns])


def wide_table(lines: DataFrame) -> DataFrame:
    """(key, words and the wide sketch) of every line that has it."""
    long = lines.where(F.col("words") >= LONG).select("key", "words", *WIDE)
    return long.groupBy("key").agg(*[F.first(c).alias(c) for c in ("words", *WIDE)])


def wide_apart(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """The pairs (kind, a, b) that wide sketches, where both have one, let be similar."""
    both = pairs.join(wide.withColumnRenamed("key", "a"), "a", "left")
    other = as_other(wide, "key", "words", *WIDE).withColumnRenamed("o_key", "b")
    apart = functools.reduce(Column.__add__, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"o_{c}"))) for c in WIDE])
    most = F.floor(F.greatest("words", "o_words") * (1 - SIMILARITY) + 1e-9)
    close = apart <= 2 * most - F.abs(F.col("words") - F.col("o_words"))
    return both.join(other, "b", "left").where(F.coalesce(close, F.lit(True))).select(*pairs.columns)


def leader_pairs(near_ones: DataFrame) -> DataFrame:
    """(a, b): in blocks of many nodes, the smallest node with every node near it; in others, each node's smallest near one."""
    led, pairs = (near_ones.where(F.col("kind") == kind).select("a", "b") for kind in (LED, PAIR))
    return led.unionByName(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")).distinct()


def rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs with the ``root`` of either node; a node without one is its own."""
    for side in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("key").alias(side), F.col("root").alias(f"{side}_root")), side, "left")
    return pairs.select("a", "b", F.coalesce("a_root", "a").alias("a_root"), F.coalesce("b_root", "b").alias("b_root"))


def joined_roots(roots: DataFrame, more: DataFrame) -> DataFrame:
    """(key, root) after the edges ``more`` between nodes of different roots; only the roots are linked anew."""
    tops = components(rooted(more, roots), "a_root", "b_root").select(F.col("node").alias("root"), F.col("root").alias("top"))
    return roots.join(tops, "root", "full").select(F.coalesce("key", "root").alias("key"), F.coalesce("top", "root").alias("root"))


def crowded_nodes(met: DataFrame, wide: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes of crowded blocks that are near one of the same block with another ``root``, with all that tells so."""
    crowds = met.where(F.col("kind") == CROWDED).select(F.col("a").alias("key"), F.col("b").alias("block"), "words", "high", "low")
    known = wide.drop("words").join(roots, "key", "full")
    placed = crowds.join(known, "key", "left").select("block", "key", "words", "high", "low", F.coalesce("root", "key").alias("root"), *WIDE)

    def per_share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, found in crowd_pairs(batches):
            yield from block.take(pa.array(np.unique(np.concatenate([np.zeros(0, np.int64), *(x for pair in found for x in pair)])))).to_batches()

    return placed.repartition("block").mapInArrow(per_share, placed.schema)


def crowd_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Of every crowded block its rows, their roots and the places of near ones whose roots differ; all rows of a block come together.

    Nodes of a block are in the order of their words, so that each meets only those that may be as long.
    """
    held = list(batches)
    if not sum(batch.num_rows for batch in held):
        return
    table = pa.Table.from_batches(held)
    table = table.take(pa.array(np.lexsort((table.column("words").to_numpy(), table.column("block").to_numpy()))))
    bounds = group_bounds(table, ["block"])
    every_root = table.column("root").to_numpy()
    for start, end in zip(bounds[:-1], bounds[1:]):
        root = every_root[start:end]
        if (root != root[0]).any():
            rows = table.slice(start, end - start)
            yield rows, root, near_places(rows, root)


def near_places(rows: pa.Table, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the near rows of a block whose roots differ, a part at a time."""
    words = rows.column("words").to_numpy().astype(np.int64)
    # Unsigned, as bits of a signed number are counted in its absolute value.
    high, low = (rows.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
    wide = np.stack([rows.column(c).fill_null(0).to_numpy().view(np.uint64) for c in WIDE], axis=1)
    step = max(1, (1 << 18) // len(words))
    for i in range(0, len(words), step):
        last = min(i + step, len(words))
        # The longest line that may be similar to the last one here.
        until = int(np.searchsorted(words, int(words[last - 1] / SIMILARITY + 1e-9) + 1, "right"))
        a, b = np.arange(i, last)[:, None], np.arange(i, until)[None, :]
        most = edits_allowed(words[i:until])[None, :]
        longer = words[b] - words[a]
        apart = np.bitwise_count(high[a] ^ high[b]).astype(np.int64) + np.bitwise_count(low[a] ^ low[b])
        left, right = np.nonzero((a < b) & (longer <= most) & (apart <= 2 * most - longer) & (root[a] != root[b]))
        left, right = left + i, right + i
        # Of two lines of which one is too short for the wide sketch, the other sketch decides alone.
        apart = np.bitwise_count(wide[left] ^ wide[right]).sum(axis=1, dtype=np.int64)
        close = (words[left] < LONG) | (apart <= 2 * edits_allowed(words[right]) - (words[right] - words[left]))
        yield left[close], right[close]


def crowd_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): similar nodes that link all those of a crowded block that are similar; rows hold their ``text`` and all their ``blocks``.

    A pair is compared in the first of its blocks alone, and not if it is linked there by then, so a block gives fewer edges than it has rows.
    """
    for rows, root, found in crowd_pairs(batches):
        keys, texts, block = rows.column("key").to_pylist(), rows.column("text").to_pylist(), rows.column("block")[0].as_py()
        blocks = list(map(set, rows.column("blocks").to_pylist()))
        top: dict[int, int] = {}

        def of(node: int) -> int:
            while node in top:
                node = top[node]
            return node

        edges = []
        for left, right in found:
            for i, j in zip(left.tolist(), right.tolist()):
                one, other = of(int(root[i])), of(int(root[j]))
                if one != other and min(blocks[i] & blocks[j]) == block and similar(texts[i], texts[j]):
                    top[max(one, other)] = min(one, other)
                    edges.append((keys[i], keys[j]))
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], names=["a", "b"])


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) of the wanted (key, row, line), read from the documents that hold them."""
    asked = wanted.groupBy("row").agg(F.collect_list(F.struct("line", "key")).alias("asked"))
    texts = docs.select(F.col("text").cast("string").alias("text"), row_hash().alias("row"))
    held = thinned(texts, wanted, "row").join(asked.hint("shuffle_hash"), "row").select("text", "asked")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = [], []
            for text, wanted_lines in zip(byte_texts(batch, "text"), batch.column("asked").to_pylist()):
                lines = text.split(b"\n")
                for one in wanted_lines:
                    keys.append(one["key"])
                    texts.append(b" ".join(words_of(lines[one["line"]])))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.binary())], names=["key", "words"])

    # Rows that repeat a document give the same key and text again.
    return held.mapInArrow(per_batch, "key long, words binary").groupBy("key").agg(F.first("words").alias("words"))


def similar(left: bytes, right: bytes) -> bool:
    a, b = left.split(b" "), right.split(b" ")
    most = int((1 - SIMILARITY) * max(len(a), len(b)) + 1e-9)
    # Every word that only one side has costs an edit.
    have, other = set(a), set(b)
    return max(len(have - other), len(other - have)) <= most and bounded(a, b, most) is not None


def verified(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, left, right) whose words are similar enough."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = list(map(similar, batch.column("left").to_pylist(), batch.column("right").to_pylist()))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "left", "right").mapInArrow(per_batch, "a long, b long")


def met_texts(docs: DataFrame, nodes: DataFrame, named: DataFrame) -> DataFrame:
    """(key, words) of the nodes ``named`` (key)."""
    named = named.distinct()
    wanted = stage(thinned(nodes, named, "key").join(named, "key").select("key", F.col("first.r").alias("row"), F.col("first.l").alias("line")))
    texts = stage(line_texts(docs, wanted))
    release(docs.sparkSession)
    return texts


def nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))


def edges_of(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose texts are similar enough."""
    left = texts.select(F.col("key").alias("a"), F.col("words").alias("left"))
    right = texts.select(F.col("key").alias("b"), F.col("words").alias("right"))
    # Pairs repeat few numbers, so their files look small beside what they take in memory: no broadcast.
    found = stage(verified(pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")))
    release(texts.sparkSession)
    return found


def dropped_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """(doc_id, row, line, kept_doc_id, kept_line): lines to drop, and the occurrence that stays instead.

    In crowded blocks every node is first linked to the smallest one, in others to its smallest near one,
    so that a large group of like lines costs a link a line; of the near pairs all that aren't
    grouped by then are compared, those of a crowded block one after another as long as they aren't linked.
    The groups are those of all pairs.
    """
    lines = stage(line_table(docs, short))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("row").alias("r"), F.col("line").alias("l"))
    nodes = stage(lines.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("first")))
    met, wide = meetings(lines), stage(wide_table(lines))
    near_ones = stage(wide_apart(met.where(F.col("kind") != CROWDED).select("kind", "a", "b").distinct(), wide))
    release(docs.sparkSession)
    leaders = leader_pairs(near_ones)
    roots = components(edges_of(met_texts(docs, nodes, nodes_of(leaders)), leaders)).withColumnRenamed("node", "key")
    pairs = rooted(near_ones.where(F.col("kind") == PAIR).select("a", "b"), roots)
    pairs = stage(pairs.where("a_root != b_root").select("a", "b").distinct())
    crowded = stage(crowded_nodes(met, wide, roots))
    release(docs.sparkSession)
    texts = met_texts(docs, nodes, nodes_of(pairs).unionByName(crowded.select("key")))
    rest = ["words", "high", "low", "root", *WIDE]
    crowded = crowded.groupBy("key").agg(F.collect_list("block").alias("blocks"), *[F.first(c).alias(c) for c in rest])
    crowded = crowded.join(texts.select("key", F.col("words").alias("text")), "key").withColumn("block", F.explode("blocks"))
    linked = stage(crowded.repartition("block").mapInArrow(crowd_edges, "a long, b long"))
    roots = joined_roots(roots, edges_of(texts, pairs).unionByName(linked))
    release(docs.sparkSession)
    grouped = nodes.select("key", "n", "first").join(roots, "key", "left").where("n > 1 or root is not null")
    grouped = grouped.withColumn("root", F.coalesce("root", "key"))
    kept = grouped.groupBy("root").agg(F.min("first").alias("kept"))
    decided = stage(grouped.join(kept, "root").select("key", "kept"))
    return (
        thinned(lines.select("key", "doc_id", "row", "line"), decided, "key")
        .join(decided, "key")
        .where((F.col("row") != F.col("kept.r")) | (F.col("line") != F.col("kept.l")))
        .select("doc_id", "row", "line", F.col("kept.id").alias("kept_doc_id"), F.col("kept.l").alias("kept_line"))
        .distinct()
    )


def drop_lines(docs: DataFrame, counted: bool = False, short: bool = False) -> DataFrame:
    """``docs`` without the lines to drop, all other columns as they were; with ``counted`` also n_lines and n_dropped
    (with underscores behind, where ``docs`` has such a column).

    With ``short`` exact repeats of lines under ``LEAST_WORDS`` words go as well.
    """
    row, gone_lines = unused(docs, "_row"), unused(docs, "_drops")
    with scratch(docs.sparkSession):
        drops = stage(dropped_lines(docs, short).groupBy(F.col("row").alias(row)).agg(F.collect_list("line").alias(gone_lines)), lasting=True)
    columns = docs.columns
    totals_named = [unused(docs, "n_lines"), unused(docs, "n_dropped")]
    named, asked = docs.withColumn(row, row_hash()), drops.select(row)
    # Only documents that lose lines travel to them.
    joined = thinned(named, asked, row).join(drops.hint("shuffle_hash"), row, "left").unionByName(thinned(named, asked, row, held=False), allowMissingColumns=True)
    joined = joined.select(*[F.col(f"`{c}`") for c in columns], gone_lines)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, gone = [], [], []
            for text, found in zip(byte_texts(batch, "text"), batch.column(gone_lines).to_pylist()):
                lines = text.split(b"\n") if text else []
                if found:
                    out = set(found)
                    text = b"\n".join([line for i, line in enumerate(lines) if i not in out])
                texts.append(text)
                totals.append(len(lines))
                gone.append(len(found or ()))
            new = pa.array(texts, pa.binary()).cast(pa.string())
            arrays = [new if c == "text" else batch.column(c) for c in columns]
            names = list(columns)
            if counted:
                arrays += [pa.array(totals, pa.int64()), pa.array(gone, pa.int64())]
                names += totals_named
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    extra = [T.StructField(n, T.LongType()) for n in totals_named] if counted else []
    return joined.mapInArrow(cut, T.StructType([*docs.schema.fields, *extra]))
