"""Hard negatives by filtering on segment summaries.

A vector is cut into segments; of each segment its mean and its deviation (the
length of what remains without the mean) are kept. The part of an inner product
that falls into a segment is the product of the means times the segment's width, plus
or minus at most the product of the deviations. So sums over segments bound a
score from both sides. Bounds start from one segment and every level cuts
segments into four; after each level only rows whose bounds may still reach an
anchor's answer remain, and what is left after the last level is scored exactly.

Two passes do this: the first finds an anchor's best rows of its own label (the
positives), the second for every positive the best rows of other labels whose
score lies in the window below the positive's. In both, all rows are dealt at random
into groups of about ``VALUES`` components; a group stays in one task, and the anchors
are sent to every group and streamed past it. A group answers with its best few
per anchor, and the best of all groups are taken with a window that ranks before
it shuffles. Only anchors are copied, never rows; nothing passes the driver.

Scores are exact whole numbers: in doubles as long as they fit 53 bits, else in
Python's integers; a score beyond a long counts as the longest long.

Memory a task: one group and its summaries, one batch of anchors. Edge cases: rows with a null id,
label or vector, or a null component, take no part; vectors are compared with those
of equal length; empty vectors score zero; rows repeating an id are rows of their own, but
no positives of an anchor with that id; equal anchor rows are one anchor; ties go to
the smaller id; an anchor without positives, and a positive without rows in its window, return no row;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.common import stage

VALUES = 1 << 23
FINEST, CUT = 4, 4
EXACT = float(1 << 53)
LONGEST = (1 << 63) - 1
ASKS = "anchor_id long, anchor long, place int, score long, other_id long"
Useful = Callable[[np.ndarray, np.ndarray], np.ndarray]


def usable(vectors: DataFrame) -> Column:
    """Whether a row takes part: an id, a label and a vector without null components."""
    return F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("vector", lambda x: x.isNotNull()), F.lit(False)
    )


def levels(width: int) -> list[np.ndarray]:
    """Starts of the segments, coarse to fine: one, then four times as many, down to ``FINEST`` components each."""
    out, count = [], 1
    while count == 1 or width >= count * FINEST:
        out.append(np.unique(np.arange(count) * width // count))
        count *= CUT
    return out


def summaries(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level the means, times the root of the width, and the deviations of every row's segments."""
    out, width = [], values.shape[1]
    for starts in levels(width) if width else []:
        widths = np.diff(np.append(starts, width))
        means = np.add.reduceat(values, starts, axis=1) / widths
        rest = values - np.repeat(means, widths, axis=1)
        out.append((means * np.sqrt(widths), np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))))
    return out


class Group:
    """Rows of one vector length, ordered by label and id, with their summaries."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        values = self.vectors.astype(np.float64)
        self.largest = np.abs(values).max(initial=0.0)
        self.levels = summaries(values)
        self.norms = np.sqrt((values * values).sum(axis=1))

    def of_label(self, label: str) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + "\0"]))

    def narrowed(self, rows: np.ndarray, vector: np.ndarray, useful: Useful) -> np.ndarray:
        """The rows that ``useful`` keeps by ever finer bounds of their scores with ``vector``."""
        values = vector.astype(np.float64)[None, :]
        # Sums of doubles stray by parts in 1e16 of the norms; bounds give way by far more.
        slip = self.norms * (1e-9 * np.sqrt((values * values).sum())) + 1e-6
        for (means, apart), (mean, far) in zip(self.levels, summaries(values)):
            if not len(rows):
                break
            middle, reach = means[rows] @ mean[0], apart[rows] @ far[0] + slip[rows]
            rows = rows[useful(middle - reach, middle + reach)]
        return rows

    def scores(self, rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
        mine = self.vectors[rows]
        if self.largest * np.abs(vector.astype(np.float64)).max(initial=0.0) * max(len(vector), 1) < EXACT:
            return (mine.astype(np.float64) @ vector.astype(np.float64)).astype(np.int64)
        whole = mine.astype(object) @ vector.astype(object)
        return np.array([min(max(int(s), -LONGEST), LONGEST) for s in whole], dtype=np.int64)


def first(ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:most]


def at_least_best(most: int) -> Useful:
    """Keeps rows that may be among the ``most`` best: their upper bound reaches the ``most``-th best lower bound."""

    def useful(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= np.partition(low, -most)[-most] if len(low) > most else np.ones(len(low), dtype=bool)

    return useful


def in_windows(windows: Sequence[tuple[float, float]], most: int) -> Useful:
    """Keeps rows that may be among the ``most`` best of some window of scores."""

    def useful(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        kept = np.zeros(len(low), dtype=bool)
        for least, top in windows:
            sure = low[(low >= least) & (high <= top)]
            if len(sure) >= most:
                least = np.partition(sure, -most)[-most]
            kept |= (high >= least) & (low <= top)
        return kept

    return useful


def best_positives(group: Group, anchor_id: int, label: str, vector: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """(1, score, id) of the best rows of the anchor's label."""
    span = group.of_label(label)
    rows = np.arange(span.start, span.stop)
    rows = group.narrowed(rows[group.ids[rows] != anchor_id], vector, at_least_best(most))
    scores = group.scores(rows, vector)
    for i in first(group.ids[rows], scores, most):
        yield 1, int(scores[i]), int(group.ids[rows[i]])


def best_negatives(group: Group, label: str, vector: np.ndarray, positives: list[int], most: int, low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(positive's place, score, id) of the best rows of other labels in the window of every positive."""
    span = group.of_label(label)
    rows = np.append(np.arange(span.start), np.arange(span.stop, len(group.ids)))
    windows = [(low * p / 100, high * p / 100) for p in positives if low * p <= high * p]
    rows = group.narrowed(rows, vector, in_windows(windows, most))
    scores = group.scores(rows, vector)
    hundred = [100 * int(s) for s in scores] if len(scores) and np.abs(scores.astype(np.float64)).max() > 1e15 else 100 * scores
    for place, p in enumerate(positives, 1):
        inside = np.flatnonzero((np.asarray(hundred) >= low * p) & (np.asarray(hundred) <= high * p))
        for i in inside[first(group.ids[rows[inside]], scores[inside], most)]:
            yield place, int(scores[i]), int(group.ids[rows[i]])


def vectors_of(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """(lengths, vectors) of a batch's rows."""
    column = batch.column("vector")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.array(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    return lengths, np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else []


def built(batches: list[pa.RecordBatch]) -> dict[int, Group]:
    """A task's rows by vector length."""
    columns: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        lengths, vectors = vectors_of(batch)
        ids, labels = batch.column("vec_id").to_numpy(), np.array(batch.column("label").to_pylist(), dtype=object)
        for width in np.unique(lengths):
            at = np.flatnonzero(lengths == width)
            columns.setdefault(int(width), []).append((ids[at], labels[at], np.array([vectors[i] for i in at], dtype=np.int64).reshape(len(at), width)))
    out = {}
    for width, held in columns.items():
        ids, labels, vectors = (np.concatenate(part) for part in zip(*held))
        small = vectors.min(initial=0) > -(1 << 31) and vectors.max(initial=0) < 1 << 31
        out[width] = Group(ids, labels, vectors.astype(np.int32) if small else vectors)
    return out


def answered(batches: Iterator[pa.RecordBatch], answer: Callable[[Group, int, str, np.ndarray, list[int]], Iterator[tuple[int, int, int]]]) -> Iterator[pa.RecordBatch]:
    """Reads sorted (group, rows before anchors) batches: keeps a group's rows, answers its anchors as they come."""
    current, rows, groups = None, [], None
    for batch in batches:
        key = batch.column("part").to_numpy() * 2 + batch.column("asks").to_numpy(zero_copy_only=False)
        bounds = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)]), len(key))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            piece = batch.slice(lo, hi - lo)
            if key[lo] // 2 != current:
                current, rows, groups = key[lo] // 2, [], None
            if key[lo] % 2 == 0:
                rows.append(piece)
                continue
            if groups is None:
                groups, rows = built(rows), []
            found = []
            lengths, vectors = vectors_of(piece)
            facts = zip(*(piece.column(c).to_pylist() for c in ("vec_id", "anchor", "label", "scores")))
            for (anchor_id, anchor, label, scores), width, vector in zip(facts, lengths, vectors):
                if int(width) in groups:
                    found += [(anchor_id, anchor, *row) for row in answer(groups[int(width)], anchor_id, label, vector, scores)]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            columns = zip(*found) if found else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["anchor_id", "anchor", "place", "score", "other_id"])


def compared(rows: DataFrame, anchors: DataFrame, groups: int, most: int, answer: Callable) -> DataFrame:
    """The ``most`` best answers per anchor and place over all groups of rows."""
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    null = F.lit(None)
    dealt = rows.select(number.alias("part"), F.lit(False).alias("asks"), "vec_id", null.cast("long").alias("anchor"), "label", "vector", null.cast("array<long>").alias("scores"))
    asks = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"), F.lit(True).alias("asks"), "vec_id", "anchor", "label", "vector", "scores")
    sorted_rows = dealt.unionByName(asks).repartition(groups, "part").sortWithinPartitions("part", "asks")
    found = sorted_rows.mapInArrow(lambda batches: answered(batches, answer), ASKS)
    ranked = Window.partitionBy("anchor_id", "anchor", "place").orderBy(F.col("score").desc(), "other_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, values: int = VALUES) -> DataFrame:
    """Per anchor and positive the best rows of other labels with low * positive <= 100 * score <= high * positive.

    ``vectors`` holds vec_id, label and vector (whole numbers as longs); ``low``
    and ``high`` are per cent.
    """
    spark = vectors.sparkSession
    rows = stage(vectors.where(usable(vectors)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("vector").cast("array<long>").alias("vector"), is_anchor.alias("_anchor")))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("width")).first()
    # Small tables still use every core; beyond that groups grow in number, not in size.
    groups = max(-(-size.n * max(size.width, 1) // values), spark.sparkContext.defaultParallelism)
    asking = rows.where("_anchor").select("vec_id", "label", "vector").dropDuplicates().withColumn("anchor", F.xxhash64("vec_id", "label", "vector"))

    anchors = stage(asking)
    best = compared(
        rows, anchors.withColumn("scores", F.lit(None).cast("array<long>")), groups, positives,
        lambda group, anchor_id, label, vector, _: best_positives(group, anchor_id, label, vector, positives),
    )
    best = stage(best.select("anchor_id", "anchor", F.col("rank").alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    told = best.groupBy("anchor_id", "anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda s: s.positive_score).alias("scores"))
    again = anchors.join(told, (F.col("vec_id") == F.col("anchor_id")) & (anchors.anchor == told.anchor)).select("vec_id", anchors.anchor, "label", "vector", "scores")
    found = compared(
        rows, again, groups, negatives,
        lambda group, anchor_id, label, vector, scores: best_negatives(group, label, vector, scores, negatives, low, high),
    )
    return found.join(best, ["anchor_id", "anchor", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
