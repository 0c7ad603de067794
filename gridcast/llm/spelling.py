"""Groups spelling variants: words one edit apart, found in k-d trees over letter counts.

One edit changes a word's letter counts by an L1 distance of at most two: a
replaced letter takes one away and adds one, an inserted letter adds one. For
every pair of lengths (equal, or one longer) the words of one length are the
points of a k-d tree and the others ask it for the points so near; a subtree is
left out when its bounding box is too far. What comes back is compared letter
by letter.

The tree has two parts. Its upper part is fitted per length on a bounded sample
of the words, goes to every task and deals the words into cells: a word belongs
to one cell as a point and goes as a question to all cells its range touches.
The lower part is built where a cell's points lie, down to leaves of ``LEAF``
points. Cells with more than ``CELL`` points or ``ASKED`` questions are dealt into
pieces that meet each other once, so neither a crowded cell nor a popular length
stays in one task. Every word is indexed and asked for; the sample only places the cuts.

Memory a task: one piece of a cell, one chunk of candidates, and while counting a
table of at most ``HELD`` words. Edge cases: null and empty texts have no words; a
null doc_id is named by the empty text when letters are dropped; texts and words
of any length are read whole; repeated rows count again; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import parts, stage, streamed_groups

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LETTERS = 26 + 64
SHORTEST, SELDOM, DROPPED = 7, 2, 31
SAMPLE, CELL, ASKED, LEAF = 100_000, 16_384, 65_536, 128
HELD = 200_000
CHUNK = 1 << 22


# --- words and their counts -------------------------------------------------------


def damaged(words: Counter[str], doc: str, every: int) -> Iterator[tuple[str, int]]:
    """A document's lower-cased runs with their counts, some of them with one letter dropped by a checksum."""
    start = zlib.crc32(f"{doc}:".encode())
    for word, n in words.items():
        h = zlib.crc32(word.encode(), start)
        if h % every == 0:
            word = word[: h % len(word)] + word[h % len(word) + 1 :]
        yield word, n


def word_counts(docs: DataFrame, shortest: int = SHORTEST, every: int = DROPPED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words of at least ``shortest`` letters; tasks add up before the shuffle."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in parts(batches, 64):
            for doc, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found: Counter[str] = Counter()
                for run, n in Counter(RUN.findall(t or "")).items():
                    # Dropping a letter only shortens, so shorter runs cannot become words.
                    if len(run) >= shortest:
                        found[run.lower() if run.isascii() else run.translate(LOWER)] += n
                for word, n in damaged(found, doc or "", every):
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) >= HELD:
                    yield counted(held)
                    held.clear()
        yield counted(held)

    def counted(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    read = docs.selectExpr(f"cast(`{doc_id}` as string) as doc_id", f"cast(`{text}` as string) as text")
    return read.mapInArrow(per_batch, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(words: list[str]) -> np.ndarray:
    """One row a word: how often it holds each of the letters a to z and U+00C0 to U+00FF."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    letter = np.where(codes < 0xC0, codes - 97, codes - 0xC0 + 26)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * LETTERS + letter, minlength=len(words) * LETTERS).reshape(-1, LETTERS).astype(np.int32)


# --- k-d trees ----------------------------------------------------------------------


def best_cut(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter and count whose cut halves the points best; None if all points are equal."""
    best, wanted = None, len(counts) / 2
    for letter in np.flatnonzero(counts.min(axis=0) < counts.max(axis=0)):
        below = np.cumsum(np.bincount(counts[:, letter]))[:-1]
        cut = int(np.abs(below - wanted).argmin())
        if 0 < below[cut] < len(counts) and (best is None or abs(below[cut] - wanted) < best[0]):
            best = (abs(below[cut] - wanted), int(letter), cut)
    return best and best[1:]


@dataclass
class Cells:
    """The upper tree of one length: inner nodes cut a letter's count, leaves number the cells."""

    letter: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    below: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    leaves: int = 0

    def grow(self, counts: np.ndarray, most: int) -> int:
        """Adds a node over the sampled points; returns it, or a leaf as a negative number."""
        chosen = best_cut(counts) if len(counts) > most else None
        if chosen is None:
            self.leaves += 1
            return -self.leaves
        node = len(self.letter)
        for column, value in zip((self.letter, self.cut, self.below, self.above), (*chosen, 0, 0)):
            column.append(value)
        low = counts[:, chosen[0]] <= chosen[1]
        self.below[node], self.above[node] = self.grow(counts[low], most), self.grow(counts[~low], most)
        return node

    def reached(self, counts: np.ndarray, more: int, fewer: int) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, rows) for all cells that may hold points with ``more`` letters added and ``fewer`` taken away."""
        rows = np.arange(len(counts))
        none = np.zeros(len(counts), dtype=np.int32)
        waiting = [(0 if self.letter else -1, rows, none, none, {}, {})]
        while waiting:
            node, rows, added, taken, low, high = waiting.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -node - 1, rows
                continue
            letter, cut = self.letter[node], self.cut[node]
            mine = counts[rows, letter]
            # The box's edge moves in: what the former edge had cost already is not paid twice.
            paid = np.maximum(mine - high[letter], 0) if letter in high else 0
            now = taken + np.maximum(mine - cut, 0) - paid
            keep = now <= fewer
            waiting.append((self.below[node], rows[keep], added[keep], now[keep], low, {**high, letter: cut}))
            paid = np.maximum(low[letter] - mine, 0) if letter in low else 0
            now = added + np.maximum(cut + 1 - mine, 0) - paid
            keep = now <= more
            waiting.append((self.above[node], rows[keep], now[keep], taken[keep], {**low, letter: cut + 1}, high))


def fit_cells(sample: list[str], total: int, cell: int) -> dict[int, Cells]:
    """Upper trees by length; a leaf of the sample stands for about ``cell`` words of all."""
    by_length: dict[int, list[str]] = {}
    for word in sample:
        by_length.setdefault(len(word), []).append(word)
    most = max(int(cell * len(sample) / max(total, 1)), 8)
    out = {}
    for length, words in by_length.items():
        out[length] = Cells()
        out[length].grow(letter_counts(words), most)
    return out


def unary(counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Counts written as ones, ``most[k]`` places for letter k: the product of two rows is what the words share."""
    letter = np.repeat(np.arange(len(most)), most)
    place = np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most)
    return (counts[:, letter] > place).astype(np.float32)


def in_range(points: np.ndarray, asked: np.ndarray, more: int, fewer: int, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of ``asked``, rows of ``points``) where a point has exactly ``more`` letters added and ``fewer`` taken away.

    A leaf's points and the rows that reach it are compared by one product: they
    share all letters but the ``fewer``. Letters that no point holds cost what
    they cost everywhere, so they only narrow the rows at the root.
    """
    tree = Cells()
    lots: list[np.ndarray] = []

    def grow(rows: np.ndarray) -> int:
        cut = best_cut(points[rows]) if len(rows) > leaf else None
        if cut is None:
            lots.append(rows)
            return -len(lots)
        node = len(tree.letter)
        for column, value in zip((tree.letter, tree.cut, tree.below, tree.above), (*cut, 0, 0)):
            column.append(value)
        low = points[rows, cut[0]] <= cut[1]
        tree.below[node], tree.above[node] = grow(rows[low]), grow(rows[~low])
        return node

    grow(np.arange(len(points)))
    size = int(asked[0].sum())
    for lot, rows in tree.reached(asked, more, fewer):
        mine = points[lots[lot]]
        # The tight box of the leaf leaves out rows that its cuts alone let in.
        low, high = mine.min(axis=0), mine.max(axis=0)
        rows = rows[np.maximum(asked[rows] - high, 0).sum(axis=1) <= fewer]
        rows = rows[np.maximum(low - asked[rows], 0).sum(axis=1) <= more]
        held = unary(mine, high)
        step = max(CHUNK // max(*held.shape, 1), 1)
        for i in range(0, len(rows), step):
            shared = unary(np.minimum(asked[rows[i : i + step]], high), high) @ held.T
            a, b = np.nonzero(shared == size - fewer)
            if len(a):
                yield rows[i : i + step][a], lots[lot][b]


def one_edit(short: list[str], long: list[str]) -> np.ndarray:
    """Whether each word becomes its partner, of the same length or one letter longer, by exactly one edit."""
    n, m = len(short[0]), len(long[0])
    a = np.frombuffer("".join(short).encode("utf-32-le"), dtype="<u4").reshape(-1, n)
    b = np.frombuffer("".join(long).encode("utf-32-le"), dtype="<u4").reshape(-1, m)
    if n == m:
        return (a != b).sum(axis=1) == 1
    front = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= n


def near_in(points: list[str], asked: list[str], leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of ``asked``, rows of ``points``) one edit apart; both lists hold one length, points are as long or one longer."""
    if not points or not asked:
        return
    longer = len(points[0]) > len(asked[0])
    for a, b in in_range(letter_counts(points), letter_counts(asked), 1, 0 if longer else 1, leaf):
        step = max(CHUNK // len(points[0]), 1)
        for i in range(0, len(a), step):
            q, p = a[i : i + step], b[i : i + step]
            right = one_edit([asked[k] for k in q], [points[k] for k in p])
            if right.any():
                yield q[right], p[right]


# --- the join -------------------------------------------------------------------------

ROUTED = "word string, n long, cell long, asks boolean"
LINKS = "word string, near string, near_n long"


def route(words: DataFrame, trees: dict[int, Cells]) -> DataFrame:
    """Every word once in its own cell and as a question in all cells its range touches; a cell names its points' length."""
    # Plain values: a broadcast class would have to be importable where the task runs.
    shared = words.sparkSession.sparkContext.broadcast({length: vars(tree) for length, tree in trees.items()})

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Cells(leaves=1)
        trees = {length: Cells(**tree) for length, tree in shared.value.items()}
        for batch in batches:
            names, ns = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            lengths = np.array([len(w) for w in names])
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                word, n = [names[i] for i in at], ns[at]
                counts = letter_counts(word)
                for span, more, fewer, asks in ((0, 0, 0, False), (0, 1, 1, True), (1, 1, 0, True)):
                    tree = trees.get(int(length) + span, whole)
                    for cell, rows in tree.reached(counts, more, fewer):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([word[i] for i in rows], pa.string()),
                                pa.array(n[rows], pa.int64()),
                                pa.array(np.full(len(rows), (int(length) + span) << 24 | cell), pa.int64()),
                                pa.array(np.full(len(rows), asks)),
                            ],
                            names=["word", "n", "cell", "asks"],
                        )

    return words.select("word", "n").mapInArrow(per_batch, ROUTED)


def links(words: DataFrame, sample: int = SAMPLE, cell: int = CELL, asked: int = ASKED, leaf: int = LEAF) -> DataFrame:
    """(word, near, near_n): both directions of every pair of words one edit apart; ``words`` holds (word, n), each word once."""
    spark = words.sparkSession
    total = words.count()
    some = words.where(F.pmod(F.xxhash64("word", F.lit(12)), F.lit(max(total, 1))) < sample).select("word")
    trees = fit_cells(sorted(r[0] for r in some.collect()), total, cell)
    routed = stage(route(words, trees))
    # One row a cell, and cells are bounded by the sample.
    sizes = routed.groupBy("cell").agg(
        F.ceil(F.count_if(~F.col("asks")) / cell).alias("_points"), F.greatest(F.lit(1), F.ceil(F.count_if("asks") / asked)).alias("_asked")
    )
    part = F.pmod(F.xxhash64("word"), F.when(F.col("asks"), F.col("_asked")).otherwise(F.col("_points")))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("asks"), F.col("_points")).otherwise(F.col("_asked")) - 1)
    dealt = (
        routed.join(F.broadcast(sizes.where("_points > 0")), "cell")
        .withColumn("_own", part)
        .withColumn("_other", F.explode(others))
        .select("word", "n", "cell", "asks", F.when(F.col("asks"), F.col("_other")).otherwise(F.col("_own")).alias("p"), F.when(F.col("asks"), F.col("_own")).otherwise(F.col("_other")).alias("q"))
    )

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in streamed_groups(batches, ["cell", "p", "q"]):
            yield from near_of_groups(group, leaf)

    count = max(spark.sparkContext.defaultParallelism * 2, -(-total // cell))
    return dealt.repartition(count, "cell", "p", "q").sortWithinPartitions("cell", "p", "q").mapInArrow(per_batch, LINKS)


def near_of_groups(table: pa.Table, leaf: int) -> Iterator[pa.RecordBatch]:
    """Links inside each piece of a cell; the longer word of a pair learns of it here as well."""
    cells = np.stack([table.column(k).to_numpy() for k in ("cell", "p", "q")], axis=1)
    bounds = np.append(np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]).any(axis=1))), len(cells))
    words, ns, asks = table.column("word").to_pylist(), table.column("n").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
    lengths = np.array([len(w) for w in words])
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        points = np.arange(lo, hi)[~asks[lo:hi]]
        if not len(points):
            continue
        for length in (lengths[points[0]], lengths[points[0]] - 1):
            asking = np.arange(lo, hi)[asks[lo:hi] & (lengths[lo:hi] == length)]
            for a, b in near_in([words[i] for i in points], [words[i] for i in asking], leaf):
                a, b = asking[a], points[b]
                if length < lengths[points[0]]:
                    a, b = np.append(a, b), np.append(b, a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[i] for i in a], pa.string()), pa.array([words[i] for i in b], pa.string()), pa.array(ns[b], pa.int64())],
                    names=["word", "near", "near_n"],
                )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last, by doubling.

    A form is at least ``ten`` times as frequent as its word, so no chain is longer
    than a count has digits; rounds end when none moves any more.
    """
    current = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stage(current.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        current = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return current


def group_variants(docs: DataFrame, shortest: int = SHORTEST, seldom: int = SELDOM, every: int = DROPPED, ten: int = 10, sample: int = SAMPLE, cell: int = CELL, asked: int = ASKED, leaf: int = LEAF) -> DataFrame:
    """Per word: its count, how many words are one edit away, its form, that form's count, and the root its forms lead to."""
    words = stage(word_counts(docs, shortest, every).where(F.col("n") >= seldom))
    # The most frequent near word, the smallest among equals: strings compare by code point.
    near = links(words, sample, cell, asked, leaf).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best")
    )
    joined = words.join(near, "word", "left").withColumn("_has", F.coalesce(-F.col("_best.less") >= F.col("n") * ten, F.lit(False)))
    named = stage(
        joined.select(
            "word",
            F.when(F.col("_has"), F.col("_best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("_has"), -F.col("_best.less")).alias("form_n"),
        )
    )
    ends = roots(named.where(F.col("form").isNotNull()))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
