"""Helpers that several operators share: table access, staging, words, streamed groups, components."""

from __future__ import annotations

import contextlib
import contextvars
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.session import cut_lineage, shared_dir

#: Lower-cases A-Z and turns every other ASCII byte that is no digit and no letter into a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

FILTER_BITS = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that were staged inside the innermost ``scratch``.
_staged: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("_staged", default=None)


def stage(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Write to the shared folder and read back, so that a lost executor costs no recomputation.

    Inside ``scratch`` the folder goes at its end, unless ``lasting``.
    """
    path, folders = shared_dir(df.sparkSession, "stage"), _staged.get()
    if folders is not None and not lasting:
        folders.append(path)
    return cut_lineage(df, path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was staged in it; what it computes has to be staged as ``lasting`` before."""
    folders: list[str] = []
    token = _staged.set(folders)
    try:
        yield
    finally:
        _staged.reset(token)
        for folder in folders:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        release(spark)


def release(spark: SparkSession) -> None:
    """Has the driver forget the shuffles of tables that are staged by now.

    Spark deletes shuffle files when the driver's garbage collector finds that nobody can
    ask for them, by default every half hour; jobs of many large shuffles would hold all of them until then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case runs of ASCII digits, ASCII letters and bytes above 127."""
    return text.translate(WORD_BYTES).split() if text else []


def byte_texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """UTF-8 bytes of a string column, nulls kept."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` bears it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what a task derives from long texts stays small."""
    for batch in batches:
        for i in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(i, rows)


def row_hash() -> Column:
    """Names a row by its doc_id and text, so that rows repeating a doc_id can be told apart."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("text").isNull())


def thinned(df: DataFrame, wanted: DataFrame, column: str, held: bool = True) -> DataFrame:
    """Rows of ``df`` whose hash ``column`` is in ``wanted``, and some more: one bit a hash, in a table of fixed size.

    With ``held`` false, the other rows: none of them is in ``wanted``. The table is broadcast; it has at
    most ``FILTER_BITS`` bits (8 MB in rows of 64), whatever the data. It only spares rows a shuffle;
    beyond some ten times its size in hashes it spares none, and results stay as they are.
    """
    slot = F.pmod(F.col(column), F.lit(FILTER_BITS))
    bits = (
        wanted.select(slot.alias("slot"))
        .groupBy(F.floor(F.col("slot") / 64).alias("_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("_bits"))
    )
    known = df.withColumn("_slot", slot).join(F.broadcast(bits), F.floor(F.col("_slot") / 64) == F.col("_word"), "inner" if held else "left")
    found = F.expr("coalesce(shiftrightunsigned(_bits, cast(_slot % 64 as int)) & 1, 0) = 1")
    return known.where(found if held else ~found).drop("_slot", "_word", "_bits")


def streamed_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables made of whole groups, from batches sorted by ``keys``.

    A group cut by a batch boundary is carried over, so memory holds one batch
    and one open group. Callers keep groups bounded.
    """
    open_rows: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        changed = np.zeros(n, dtype=bool)
        for k in keys:
            column = batch.column(k).to_numpy(zero_copy_only=False)
            changed[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(changed)
        first_new = 0
        if open_rows:
            last = open_rows[-1]
            same = all(last.column(k)[last.num_rows - 1].as_py() == batch.column(k)[0].as_py() for k in keys)
            if same:
                if not len(starts):
                    open_rows.append(batch)
                    continue
                first_new = int(starts[0])
                open_rows.append(batch.slice(0, first_new))
            yield pa.Table.from_batches(open_rows)
            open_rows = []
        cut = int(starts[-1]) if len(starts) else 0
        if cut > first_new:
            yield pa.Table.from_batches([batch.slice(first_new, cut - first_new)])
            first_new = cut
        open_rows = [batch.slice(first_new)]
    if open_rows:
        yield pa.Table.from_batches(open_rows)


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Offsets at which groups of a sorted table begin, with the end appended."""
    n = table.num_rows
    changed = np.zeros(n, dtype=bool)
    changed[:1] = True
    for k in keys:
        column = table.column(k).to_numpy()
        changed[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(changed), n)


def _stars(edges: DataFrame) -> DataFrame:
    """One round of large star and small star over edges (a > b); both keep every component connected.

    Each node's smallest neighbour comes from an aggregate that combines before
    the shuffle, and is joined back as one row a node; a node with very many
    neighbours is a skewed join, which adaptive execution splits.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # Rows that repeat here are harmless; they go at the end of the round.
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    linked = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of its component.

    Edges may repeat, run in either direction or be loops; nulls are ignored.
    Alternating star contractions, each round staged in the shared folder; the
    driver sees only two numbers a round.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b")
    current, before = stage(pairs.distinct()), None
    if current.isEmpty():
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        counted = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        seen = (counted[0], counted[1])
        if seen == before:
            break
        before = seen
        current = stage(_stars(current))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
