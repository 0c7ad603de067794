"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A benchmark item of m words leaks into a document if some window of the document
is within edit distance ``0.2 m`` words of it (similarity 0.8). Both sides are word
ids. The CGK random walk reads a string word by word, writes the current word
at every step and moves on or stays as a random bit of (step, word) says; two
strings at small edit distance then walk in step again soon after an edit and
agree on most of their 3m written words. Bit-sampling LSH compares a few
sampled steps at a time, in ``BANDS`` bands for each of ``WALKS`` independent walks;
windows that agree with an item on one band are verified by exact edit distance.

Windows are item-sized and begin at every word. Before they are embedded, a
condition that every true match meets leaves most of them out: an edit destroys
at most q of the item's m-q+1 runs of q words, so the window and the slack
behind it hold at least ``m - q + 1 - q * floor(0.2 m)`` known runs, for pairs and for triples.

The benchmark is taken in blocks of bounded size, one pass over the documents
each; a block's words and items are broadcast. Items under five words have no
shingle and are not searched (they occur in ordinary text).

Edge cases: null and empty texts hold no window; a null item text is no item; a
null item_id is reported as null; items repeated word for word under one id count once; repeated
documents repeat their matches; empty tables give an empty result; other columns
are kept by ``keep_clean`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import byte_texts, parts, row_hash, stage, unused, words_of
from gridcast.llm.edits import bounded

SIMILARITY = 0.8
LEAST_WORDS = 5
WALKS, BANDS, SAMPLED = 4, 12, 4
BLOCK_ITEMS, BLOCK_WORDS = 5_000, 500_000
TABLE_BITS = 20
#: Lengths of the word runs that a match must keep enough of.
RUNS = (2, 3)
#: Written words of walks that are held at a time.
WRITTEN = 4_000_000
#: Words of documents that are searched at a time.
CHUNK_WORDS = 1 << 20
RESULT = "doc_id long, row long, item_id long, similarity double, start_word long, n_words long"


def edits_allowed(m: int) -> int:
    return int((1 - SIMILARITY) * m + 1e-9)


def slots(ids: np.ndarray, size: int) -> np.ndarray:
    """Slot of every run of ``size`` words in the table of known runs; collisions only let more windows through."""
    mixed = np.zeros(max(len(ids) - size + 1, 0), dtype=np.uint64)
    for i in range(size):
        mixed = (mixed ^ ids[i : len(ids) - size + 1 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def runs_needed(m: int, size: int) -> int:
    """Runs of ``size`` words that a match of an m-word item keeps at least: an edit destroys at most ``size`` of them."""
    return m - size + 1 - size * edits_allowed(m)


class Items:
    """One block of the benchmark: vocabulary, items by size, known pairs, and the sampled keys of the items."""

    def __init__(self, rows: list[tuple[int | None, list[bytes]]]):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.words: list[np.ndarray] = []
        self.drawn: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for item_id, found in rows:
            self.ids.append(item_id)
            self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], dtype=np.int64))
        self.pad = len(self.vocabulary) + 1
        # One bit of a slot for each item size; more than 64 sizes share bits.
        self.known = {size: np.zeros(1 << TABLE_BITS, dtype=np.uint64) for size in RUNS}
        for size, known in self.known.items():
            for w in self.words:
                known[slots(w, size)] |= self.bit(len(w))
        self.by_size: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            self.by_size.setdefault(len(w), []).append(i)
        # Sizes within a quarter of each other share a first filter.
        self.classes: list[list[int]] = []
        for m in sorted(self.by_size):
            if self.classes and m <= 1.25 * self.classes[-1][0]:
                self.classes[-1].append(m)
            else:
                self.classes.append([m])
        self.keys: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for m, members in self.by_size.items():
            flat = np.concatenate([self.words[i] for i in members])
            starts = np.arange(len(members), dtype=np.int64) * m
            for walk in range(WALKS):
                bands = []
                for key in self.sampled(flat, starts, starts + m, m, walk):
                    order = np.argsort(key, kind="stable")
                    bands.append((key[order], np.array(members)[order]))
                self.keys[(m, walk)] = bands

    def draws(self, m: int, walk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Random moves by step and class of word, sampled steps, and the salts that class words anew at every step."""
        if (m, walk) not in self.drawn:
            rng = np.random.default_rng([m, walk])
            moves = rng.integers(0, 2, size=(3 * m, 64), dtype=np.int8)
            self.drawn[(m, walk)] = (moves, rng.integers(0, 3 * m, size=(BANDS, SAMPLED)), rng.integers(1, 2**62, size=3 * m, dtype=np.int64) | 1)
        return self.drawn[(m, walk)]

    @staticmethod
    def bit(m: int) -> np.uint64:
        return np.uint64(1 << m % 64)

    def sampled(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, m: int, walk: int) -> list[np.ndarray]:
        """Band keys of windows ``[start, end)`` of ``ids``: the CGK walk of 3m steps, then its sampled steps."""
        steps = 3 * m
        moves, chosen, salts = self.draws(m, walk)
        written = np.empty((steps, len(starts)), dtype=np.int64)
        at = starts.copy()
        for j in range(steps):
            inside = at < ends
            word = np.where(inside, ids[np.minimum(at, len(ids) - 1)], self.pad)
            written[j] = word
            at += moves[j][((word * salts[j]) >> 40) & 63] & inside
        keys = []
        for band in chosen:
            key = np.zeros(len(starts), dtype=np.int64)
            for j in band:
                key = key * 1_000_003 + written[j]
            keys.append(key)
        return keys

    def search(self, ids: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], tuple[float, int]]:
        """{(start, item): similarity} over concatenated documents; ``ends`` gives each word's document end."""
        found: dict[tuple[int, int], float] = {}
        n = len(ids)
        if n < LEAST_WORDS:
            return found
        marks = {}
        for size, known in self.known.items():
            marks[size] = np.zeros(n, dtype=np.uint64)
            marks[size][: n - size + 1] = known[slots(ids, size)]
            for i in range(size):
                marks[size][: n - size + 1][ids[i : n - size + 1 + i] == 0] = 0

        def held(p: np.ndarray, reach: np.ndarray, at: np.ndarray, size: int, bits: np.uint64, wanted: int) -> np.ndarray:
            """The places ``p`` whose ``reach`` words hold enough runs of one size; ``at`` lists the words that count."""
            if wanted <= 0 or not len(p):
                return p
            sums = np.concatenate([[0], np.cumsum((marks[size][at] & bits) > 0)])
            first = np.searchsorted(at, p)
            return p[sums[first + np.maximum(reach - size + 1, 0)] - sums[first] >= wanted]

        everywhere = np.arange(n)
        rare = RUNS[-1]
        for sizes in self.classes:
            span = sizes[-1] + edits_allowed(sizes[-1])
            bits = np.bitwise_or.reduce([self.bit(m) for m in sizes])
            some = held(everywhere, np.minimum(span, n - everywhere), everywhere, rare, bits, min(runs_needed(m, rare) for m in sizes))
            if not len(some):
                continue
            # From here on only the words behind the places that are left are looked at.
            covered = np.zeros(n + 1, dtype=np.int32)
            np.add.at(covered, some, 1)
            np.add.at(covered, np.minimum(some + span, n), -1)
            at = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
            for m in sizes:
                p = some
                for size in RUNS[::-1]:
                    reach = np.minimum(p + m + edits_allowed(m), ends[p]) - p
                    p = held(p, reach, at, size, self.bit(m), runs_needed(m, size))
                step = max(WRITTEN // (3 * m), 1)
                for i in range(0, len(p), step):
                    self.verify(ids, ends, p[i : i + step], m, found)
        return found

    def verify(self, ids, ends, p, m, found) -> None:
        seen: set[tuple[int, int]] = set()
        for walk in range(WALKS):
            keys = self.sampled(ids, p, np.minimum(p + m, ends[p]), m, walk)
            for key, (known, members) in zip(keys, self.keys[(m, walk)]):
                low, high = np.searchsorted(known, key), np.searchsorted(known, key, "right")
                for at in np.flatnonzero(high > low):
                    seen.update((int(p[at]), int(i)) for i in members[low[at] : high[at]])
        allowed = edits_allowed(m)
        for start, item in seen:
            window = ids[start : min(start + m + allowed, ends[start])].tolist()
            edits = bounded(self.words[item].tolist(), window, allowed, free_end=True)
            if edits is not None:
                found[(start, item)] = 1 - edits / m


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items in blocks of bounded size, read partition by partition."""
    read = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    rows: list[tuple[int | None, list[bytes]]] = []
    size = 0
    for r in read.toLocalIterator():
        found = words_of((r["text"] or "").encode())
        if len(found) < LEAST_WORDS:
            continue
        if rows and (len(rows) >= BLOCK_ITEMS or size + len(found) > BLOCK_WORDS):
            yield rows
            rows, size = [], 0
        rows.append((r["item_id"], found))
        size += len(found)
    if rows:
        yield rows


def matches_in_block(docs: DataFrame, rows: list[tuple[int | None, list[bytes]]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value)
        get = items.vocabulary.get
        for batch in parts(batches):
            doc_ids, row_ids = batch.column("doc_id"), batch.column("row")
            out: list[tuple] = []
            flat: list[int] = []
            bounds: list[tuple[int, int]] = []

            def search() -> None:
                if not flat:
                    return
                ids = np.array(flat, dtype=np.int64)
                stops = np.array([b[1] for b in bounds])
                ends = np.repeat(stops, np.diff(np.concatenate([[0], stops])))
                best: dict[tuple[int, int], tuple[float, int]] = {}
                for (start, item), similarity in items.search(ids, ends).items():
                    doc = int(np.searchsorted(stops, start, "right"))
                    entry = (similarity, -start)
                    best[(doc, item)] = max(best.get((doc, item), entry), entry)
                for (doc, item), (similarity, start) in sorted(best.items()):
                    place = bounds[doc][0]
                    before = stops[doc - 1] if doc else 0
                    out.append((doc_ids[place].as_py(), row_ids[place].as_py(), items.ids[item], similarity, -start - int(before), len(items.words[item])))
                flat.clear()
                bounds.clear()

            for i, text in enumerate(byte_texts(batch, "text")):
                flat.extend([get(w, 0) for w in words_of(text)])
                if not bounds or len(flat) > bounds[-1][1]:
                    bounds.append((i, len(flat)))
                if len(flat) >= CHUNK_WORDS:
                    search()
            bounds[:] = [b for b in bounds if b[1]]
            search()
            names = [x.split()[0] for x in RESULT.split(", ")]
            types = [pa.int64()] * 3 + [pa.float64()] + [pa.int64()] * 2
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_hash().alias("row"))
    return read.mapInArrow(per_batch, RESULT)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, row, item_id, similarity, start_word, n_words): the best place of each leaked item in each document."""
    out = None
    for rows in blocks(benchmark):
        found = matches_in_block(docs, rows)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns kept."""
    row = unused(docs, "_row")
    leaked = stage(matches(docs, benchmark)).select(F.col("row").alias(row)).distinct()
    return docs.withColumn(row, row_hash()).join(leaked, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
