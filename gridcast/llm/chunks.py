"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text: every byte value has a random
32-bit word, and the hash at a byte sums the words of the last 32 bytes, each
shifted by its distance. A chunk ends where the hash's top bits are zero and no such place lies
in the ``LEAST`` bytes before, so borders depend on 48 bytes of content only, survive insertions
elsewhere and agree in equal texts beyond their first 48 bytes.
Chunks have at most ``MOST`` bytes, about 50 on average, and never cut a character.

A chunk whose digest occurred before, in the order of doc_id, row and place, is
a repeat. Neighbouring repeats of one source at one distance form a run, which is
extended byte by byte to both sides against that source. Passages of ``WORDS`` whole words
count, as do whole texts of ``SPAN`` bytes and, for scripts without spaces, ``UNSPACED`` bytes of
any text; shorter ones are phrases that ordinary texts share. ``REACH`` bytes are compared to either side:
what a passage holds beyond is made of repeated chunks that have runs of their own, and overlapping passages are joined.

Digests are counted before they are shuffled, and only repeated digests are
joined back to their places, a join that adaptive execution splits where one
digest is very frequent. Of texts with too few neighbouring repeats nothing is compared. Memory a task: one batch and the arrays of one text.

Edge cases: null and empty texts have no chunks; a null doc_id comes last in the
order; rows equal in doc_id and text count as one document; of equal texts the
first keeps its chunks; an empty table gives an empty result; other columns are
kept by ``drop_repeats`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.common import byte_texts, row_hash, stage, thinned, unused

LEAST, MOST, CUT_BITS = 16, 2048, 5
#: A passage has ``WORDS`` whole words; a whole text that repeats has ``SPAN`` bytes; text without spaces has ``UNSPACED``.
WORDS, SPAN, UNSPACED = 50, 150, 1000
#: Chunks that may lie in the 48 bytes where borders of equal text differ, the one that follows included, and bytes compared to either side of a run.
SLACK, REACH = 5, 2048
GEAR = np.random.default_rng(20_240_601).integers(0, 2**32, size=256, dtype=np.uint32)
CHUNKS = "digest long, doc_id long, row long, start int"
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
REQUEST = {
    "row": pa.int64(), "doc_id": pa.int64(), "size": pa.int32(), "begins": pa.int32(), "ends": pa.int32(), "left": pa.binary(), "right": pa.binary(),
    "core": pa.int32(), "last": pa.binary(), "source_row": pa.int64(), "source": pa.int64(), "source_start": pa.int32(), "shift": pa.int32(),
}
SQL_TYPES = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte, by doubling the number of bytes summed."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        if len(h) <= shift:
            break
        older = h[:-shift] << np.uint32(shift)
        h = h.copy()
        h[shift:] += older
    return h


def chunk_ends(text: bytes) -> list[int]:
    """Where the chunks of a text end; the last end is its length."""
    n = len(text)
    if not n:
        return []
    data = np.frombuffer(text, dtype=np.uint8)
    starts_char = np.append((data[1:] & 0xC0) != 0x80, True)
    wanted = np.flatnonzero((gear_hashes(data) >> np.uint32(32 - CUT_BITS) == 0) & starts_char) + 1
    ends: list[int] = []
    last = 0

    def fill(until: int) -> int:
        """Cuts overlong stretches, before a character's first byte."""
        at = last
        while until - at > MOST:
            at += MOST
            while not starts_char[at - 1]:
                at -= 1
            ends.append(at)
        return at

    for end in wanted[np.diff(wanted, prepend=-LEAST) >= LEAST].tolist():
        fill(end)
        ends.append(end)
        last = end
    last = fill(n)
    if last < n:
        ends.append(n)
    return ends


def chunk_table(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, row, start) of every chunk of every text."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            digests: list[int] = []
            starts: list[int] = []
            counts: list[int] = []
            for text in byte_texts(batch, "text"):
                ends = chunk_ends(text) if text else []
                begins = [0, *ends[:-1]] if ends else []
                digests += [digest(text[a:b]) for a, b in zip(begins, ends)]
                starts += begins
                counts.append(len(ends))
            rows = pa.array(np.repeat(np.arange(len(counts)), counts), pa.int64())
            arrays = [
                pa.array(np.array(digests, dtype=np.uint64).view(np.int64), pa.int64()),
                batch.column("doc_id").take(rows),
                batch.column("row").take(rows),
                pa.array(starts, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["digest", "doc_id", "row", "start"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_hash().alias("row"))
    return read.mapInArrow(per_batch, CHUNKS)


def word_starts(text: bytes) -> np.ndarray:
    """Whether a word (no white space) starts at each byte."""
    space = SPACE[np.frombuffer(text, dtype=np.uint8)]
    starts = ~space
    starts[1:] &= space[:-1]
    return starts


def fringe_requests(texts: DataFrame, least: int, words: int) -> DataFrame:
    """For every run of repeated chunks of one source that may belong to a passage, the text to either side of it.

    ``texts`` has (row, doc_id, text, hits). Borders of equal text agree beyond its first
    48 bytes; so a passage ends in the first chunk that is no repeat, and begins at most
    ``SLACK`` chunks before the first that is one. Stretches that hold too few words
    even so are left out here, which spares most phrases the comparison.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), byte_texts(batch, "text"), batch.column("hits").to_pylist())
            for row, doc, text, hits in held:
                ends = chunk_ends(text)
                starts = [0, *ends[:-1]]
                index = {s: i for i, s in enumerate(starts)}
                seen = np.concatenate([[0], np.cumsum(word_starts(text))])
                found = sorted((index[h["start"]], h["source_row"], h["source_start"], h["source"]) for h in hits)
                i = 0
                while i < len(found):
                    j = i + 1
                    while j < len(found) and found[j][0] == found[j - 1][0] + 1:
                        j += 1
                    low, high = starts[max(found[i][0] - SLACK, 0)], ends[min(found[j - 1][0] + 1, len(ends) - 1)]
                    if seen[high] - seen[low] >= words or high - low >= UNSPACED or (low == 0 and high == len(text) and high >= least):
                        k = i
                        while k < j:
                            first, source_row, source_start, source = found[k]
                            shift = starts[first] - source_start
                            k += 1
                            while k < j and found[k][1] == source_row and starts[found[k][0]] - found[k][2] == shift:
                                k += 1
                            a, b = starts[first], ends[found[k - 1][0]]
                            left, right = text[max(low - 1, a - REACH, 0) : a], text[b : min(high + 1, b + REACH)]
                            core = int(seen[b] - seen[a])
                            out.append((row, doc, len(text), a, b, left, right, core, text[b - 1 : b], source_row, source, source_start, shift))
                    i = j
            columns = zip(*out) if out else [()] * len(REQUEST)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, REQUEST.values())], names=list(REQUEST))

    return texts.mapInArrow(per_batch, ", ".join(f"{n} {SQL_TYPES[t]}" for n, t in REQUEST.items()))


def common_end(a: bytes, b: bytes) -> int:
    """How many bytes the ends of both have in common."""
    n = min(len(a), len(b))
    if not n:
        return 0
    differ = np.flatnonzero(np.frombuffer(a[-n:], np.uint8) != np.frombuffer(b[-n:], np.uint8))
    return n - 1 - int(differ[-1]) if len(differ) else n


def common_start(a: bytes, b: bytes) -> int:
    """How many bytes the starts of both have in common."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8)) if n else ()
    return int(differ[0]) if len(differ) else n


def passages(compared: DataFrame, least: int, words: int) -> DataFrame:
    """Runs extended byte by byte to both sides, if they are long enough."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                left, right = r["left"], r["right"]
                before, after = common_end(left, r["source_left"]), common_start(right, r["source_right"])
                while before and left[-before] & 0xC0 == 0x80:
                    before -= 1
                while after and after < len(right) and right[after] & 0xC0 == 0x80:
                    after -= 1
                start, end = r["begins"] - before, r["ends"] + after
                n = r["core"] + int(word_starts(left)[len(left) - before :].sum()) + int(word_starts(r["last"] + right)[1 : after + 1].sum())
                # The last word counts if it ends with the passage.
                following = right[after : after + 1]
                final = right[after - 1 : after] if after else r["last"]
                n -= bool(following) and not SPACE[following[0]] and not SPACE[final[0]]
                whole = start == 0 and end == r["size"]
                if n >= words or end - start >= UNSPACED or (whole and end >= least):
                    out.append((r["doc_id"], r["row"], start, end, r["source"], r["source_row"]))
            columns = zip(*out) if out else [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "row", "start", "end", "source", "source_row"])

    return compared.mapInArrow(per_batch, "doc_id long, row long, start int, end int, source long, source_row long")


def repeated_spans(docs: DataFrame, least: int = SPAN, words: int = WORDS) -> DataFrame:
    """(doc_id, row, start_byte, n_bytes, source_doc_id): passages that occurred before, and where.

    Passages of one document that overlap are one span; its source is that of the passage it begins with.
    """
    cut = stage(chunk_table(docs))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("row").alias("r"), F.col("start").alias("s"))
    firsts = cut.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("digest", "first")
    hits = (
        cut.join(firsts, "digest")
        .where((F.col("row") != F.col("first.r")) | (F.col("start") != F.col("first.s")))
        .select("row", F.struct("start", F.col("first.r").alias("source_row"), F.col("first.s").alias("source_start"), F.col("first.id").alias("source")).alias("hit"))
    )
    # A row that repeats has every hit again; the set has it once, as the texts below have the row.
    hits = stage(hits.groupBy("row").agg(F.collect_set("hit").alias("hits")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_hash().alias("row"))
    held = thinned(texts, hits, "row").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    asked = stage(fringe_requests(held.join(hits, "row").select("row", "doc_id", "text", "hits"), least, words))
    sources = (
        thinned(texts, asked.select(F.col("source_row").alias("row")), "row")
        .groupBy(F.col("row").alias("source_row"))
        .agg(F.first("text").cast("binary").alias("source_text"))
    )
    left_size, right_size = F.octet_length("left"), F.octet_length("right")
    run_start, run_end = F.col("begins") - F.col("shift"), F.col("ends") - F.col("shift")
    compared = asked.join(sources, "source_row").select(
        "row", "doc_id", "size", "begins", "ends", "left", "right", "core", "last", "source_row", "source",
        F.substring("source_text", F.greatest(run_start - left_size, F.lit(0)) + 1, F.least(left_size, run_start)).alias("source_left"),
        F.substring("source_text", run_end + 1, right_size).alias("source_right"),
    )
    found = passages(compared, least, words).distinct()
    along = Window.partitionBy("row", "doc_id").orderBy("start", F.desc("end"), "source", "source_row")
    until = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("start") >= until, F.lit(True))
    spans = found.withColumn("begins", begins.cast("int")).withColumn("span", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.struct(F.col("start"), -F.col("end"), F.col("source").isNull(), F.col("source"))
    return (
        spans.groupBy("row", "doc_id", "span")
        .agg(F.min("start").alias("start_byte"), F.max("end").alias("end"), F.min_by("source", first).alias("source_doc_id"))
        .select("doc_id", "row", F.col("start_byte").cast("long"), (F.col("end") - F.col("start_byte")).cast("long").alias("n_bytes"), "source_doc_id")
    )


def drop_repeats(docs: DataFrame, least: int = SPAN, words: int = WORDS) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, all other columns as they were."""
    row, cuts = unused(docs, "_row"), unused(docs, "_spans")
    spans = repeated_spans(docs, least, words).groupBy(F.col("row").alias(row)).agg(
        F.array_sort(F.collect_set(F.struct("start_byte", "n_bytes"))).alias(cuts)
    )
    columns = docs.columns
    joined = docs.withColumn(row, row_hash()).join(spans, row, "left").select(*[F.col(f"`{c}`") for c in columns], cuts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(byte_texts(batch, "text"), batch.column(cuts).to_pylist()):
                if found:
                    kept, at = [], 0
                    for span in found:
                        kept.append(text[at : span["start_byte"]])
                        at = span["start_byte"] + span["n_bytes"]
                    text = b"".join([*kept, text[at:]])
                texts.append(text)
            new = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([new if c == "text" else batch.column(c) for c in columns], names=columns)

    return joined.mapInArrow(cut, docs.schema)
