"""Embedding near-dedup by NN-descent.

Vectors are compared within a label by cosine in double precision. Equal vectors
of a label are one node with a weight. The neighbour graph starts from buckets of random
hyperplanes and is refined by joins of neighbours of neighbours: around every
node, its neighbours (either direction) are compared with each other, and each
node keeps its best ``LIST``. A list full of neighbours at or above the threshold is
saturated and doubles, up to ``LONGEST``. Rounds end when hardly any threshold
edge is new and the audit, which compares a fixed number of query vectors with
all others, finds the recall wanted; else more buckets are drawn and the descent goes on.

Threshold edges give components. Lists have a longest size, so the links of large
groups are counted exactly afterwards: all links of a node lie in its component,
and each component is compared block by block, giving counts and no pairs.

No group is unbounded: buckets and the surroundings of popular nodes are
split at random into parts of about ``PART`` nodes, components into blocks of ``BLOCK``.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components, and null labels, link with nothing; vectors of different lengths are not compared; a null vec_id is
a node that can be linked to but names no component; rows repeating a vec_id are
rows of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.common import components, group_bounds, stage, streamed_groups

THRESHOLD = 0.93
LIST, LONGEST = 10, 40
TABLES, PLANES = 6, 10
PART, BLOCK = 64, 256
ROUNDS, NEW_SHARE = 6, 0.01
AUDITED, WANTED_RECALL, DRAWS = 200, 0.98, 4
EDGES = "u long, v long, sim double"


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit rows of a list column whose lists are equally long."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return values / np.sqrt((values * values).sum(axis=1))[:, None]


def usable(vectors: DataFrame) -> Column:
    """Whether a row can link: a label, and a finite vector that is not zero."""
    values = F.col("embedding").cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & finite & F.exists(values, lambda x: x != 0), F.lit(False))


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): each usable row's node, and per node its group (label and length), vector, weight and smallest vec_id."""
    read = vectors.where(usable(vectors)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector")
    )
    # Dividing by the largest component keeps tiny and huge vectors within doubles.
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    scaled = read.withColumn("vector", F.transform("vector", lambda x: x / largest))
    placed = scaled.withColumn("part", F.concat_ws(":", F.size("vector"), "label")).withColumn("node", F.xxhash64("part", "vector"))
    nodes = placed.groupBy("node").agg(F.first("part").alias("part"), F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("vec_id").alias("vec_id"))
    return placed.select("vec_id", "node"), nodes


def parts_of(counted: Column, member: str, salt: int) -> Column:
    """A random part of a group, as many as it takes for ``PART`` rows each."""
    return F.pmod(F.xxhash64(F.col(member), F.lit(salt)), F.ceil(counted / PART))


def local_pairs(groups: DataFrame, keys: list[str], per_node: int) -> DataFrame:
    """(u, v, sim) within each group, either direction: the best ``per_node`` of each node that beat its worst neighbour."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in streamed_groups(batches, keys):
            bounds = group_bounds(whole, keys)
            ids, worst = whole.column("node").to_numpy(), whole.column("worst").to_numpy()
            units = None
            us, vs, sims = [], [], []
            vector = whole.column("vector")
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b - a < 2:
                    continue
                units = matrix(vector.slice(a, b - a))
                sim = units @ units.T
                np.fill_diagonal(sim, -2)
                best = min(per_node, b - a - 1)
                near = np.argpartition(-sim, best - 1, axis=1)[:, :best]
                values = np.take_along_axis(sim, near, axis=1)
                i, j = np.nonzero(values > worst[a:b, None])
                us.append(ids[a + i])
                vs.append(ids[a + near[i, j]])
                sims.append(values[i, j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, sims)], names=["u", "v", "sim"])

    count = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = groups.repartition(count, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(per_batch, EDGES)


def best_lists(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node's best neighbours: ``size`` of them, its own list length."""
    once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))).where(F.col("rank") <= LONGEST)
    sized = ranked.join(nodes.select(F.col("node").alias("u"), "size"), "u")
    return sized.where(F.col("rank") <= F.col("size")).select("u", "v", "sim")


def bucket_edges(nodes: DataFrame, draw: int) -> DataFrame:
    """Pairs from buckets of random hyperplanes; every draw has its own."""
    length = nodes.select(F.max(F.size("vector"))).first()[0] or 1
    planes = np.random.default_rng([7, draw]).standard_normal((length, TABLES * PLANES))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(TABLES, dtype=np.int64)] * batch.num_rows
            for i, v in enumerate(batch.column("vector").to_pylist()):
                signs = (np.asarray(v) @ planes[: len(v)] > 0).reshape(TABLES, PLANES)
                found[i] = signs @ (1 << np.arange(PLANES)) + (np.arange(TABLES) << PLANES)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("part"), pa.array([list(f) for f in found], pa.list_(pa.int64()))], names=["node", "part", "buckets"])

    placed = nodes.select("node", "part", "vector").mapInArrow(per_batch, "node long, part string, buckets array<long>")
    placed = placed.select("node", F.explode("buckets").alias("bucket"), "part").select("node", F.xxhash64("part", "bucket").alias("bucket"))
    placed = stage(placed)
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    split = placed.join(sizes, "bucket").select("node", "bucket", parts_of(F.col("n"), "node", draw).alias("piece"))
    full = split.join(nodes.select("node", "vector"), "node").withColumn("worst", F.lit(-1.0))
    return local_pairs(full, ["bucket", "piece"], LIST)


def descend(edges: DataFrame, nodes: DataFrame, step: int) -> DataFrame:
    """One join of neighbours of neighbours around every node; returns candidates better than a node's worst neighbour."""
    both = edges.select(F.col("u").alias("pivot"), F.col("v").alias("node")).unionByName(edges.select(F.col("v").alias("pivot"), F.col("u").alias("node")))
    # A node is its own neighbour, so that those of its neighbours that don't know it meet it.
    around = both.unionByName(nodes.select(F.col("node").alias("pivot"), "node")).distinct()
    degree = around.groupBy("pivot").agg(F.count("*").alias("n"))
    split = around.join(degree, "pivot").select("pivot", parts_of(F.col("n"), "node", step).alias("piece"), "node")
    worst = edges.groupBy("u").agg(F.min("sim").alias("low"), F.count("*").alias("held")).withColumnRenamed("u", "node")
    state = nodes.join(worst, "node", "left").select(
        "node", "vector", F.when(F.col("held") >= F.col("size"), F.col("low")).otherwise(-1.0).alias("worst")
    )
    return local_pairs(split.join(state, "node"), ["pivot", "piece"], LIST)


def audit(nodes: DataFrame, linked: DataFrame, threshold: float) -> tuple[int, int]:
    """(true links, found links) of ``AUDITED`` nodes against all others; found if the two share a component."""
    queries = nodes.orderBy(F.xxhash64("node", F.lit("audit"))).limit(AUDITED).select("node", "part", "vector").collect()
    shared = nodes.sparkSession.sparkContext.broadcast([(q["node"], q["part"], q["vector"]) for q in queries])

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[str, list] = {}
        for node, part, vector in shared.value:
            by_part.setdefault(part, []).append((node, np.asarray(vector) / np.linalg.norm(vector)))
        for batch in batches:
            us, vs = [], []
            parts = np.array(batch.column("part").to_pylist(), dtype=object)
            ids = batch.column("node").to_numpy()
            for part, asked in by_part.items():
                at = np.flatnonzero(parts == part)
                if len(at):
                    sim = matrix(batch.column("vector").take(pa.array(at))) @ np.array([v for _, v in asked]).T
                    for i, j in zip(*np.nonzero(sim >= threshold)):
                        if ids[at[i]] != asked[j][0]:
                            us.append(asked[j][0])
                            vs.append(int(ids[at[i]]))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    true = nodes.select("node", "part", "vector").mapInArrow(per_batch, "u long, v long")
    a = linked.select(F.col("node").alias("u"), F.col("root").alias("root_u"))
    b = linked.select(F.col("node").alias("v"), F.col("root").alias("root_v"))
    both = true.join(a, "u", "left").join(b, "v", "left")
    row = both.agg(F.count("*"), F.coalesce(F.sum((F.col("root_u") == F.col("root_v")).cast("long")), F.lit(0))).first()
    return row[0], row[1]


def threshold_graph(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, root) of all nodes with a threshold edge, found by descent and audited."""
    nodes = stage(nodes.select("node", "part", "vector").withColumn("size", F.lit(LIST)))
    edges = stage(best_lists(bucket_edges(nodes, 0), nodes))
    kept = stage(edges.where(F.col("sim") >= threshold))
    known = kept.count()
    step = 0
    for draw in range(1, DRAWS + 1):
        for _ in range(ROUNDS):
            step += 1
            full = edges.where(F.col("sim") >= threshold).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("near"))
            grown = F.when((F.col("near") >= F.col("size")) & (F.col("size") < LONGEST), F.col("size") * 2).otherwise(F.col("size"))
            nodes = stage(nodes.join(full, "node", "left").select("node", "part", "vector", grown.alias("size")))
            edges = stage(best_lists(edges.unionByName(descend(edges, nodes, step)), nodes))
            kept = stage(kept.unionByName(edges.where(F.col("sim") >= threshold)).dropDuplicates(["u", "v"]))
            now = kept.count()
            done, known = now - known <= NEW_SHARE * now, now
            if done:
                break
        linked = stage(components(kept, "u", "v"))
        true, found = audit(nodes, linked, threshold)
        if found >= WANTED_RECALL * true or draw == DRAWS:
            return linked
        edges = stage(best_lists(edges.unionByName(bucket_edges(nodes, draw)), nodes))
    raise AssertionError("unreachable")


def exact_counts(nodes: DataFrame, linked: DataFrame, threshold: float) -> DataFrame:
    """(node, others, root): links of every node of a component, counted by comparing the component's blocks."""
    members = nodes.join(linked, "node").select("node", "root", "vector", "weight")
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")))
    # Block i meets block j in the task (min, max); each node goes to one task per block.
    tasks = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tasks = tasks.select("node", "root", "vector", "weight", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    keys = ["root", "low", "high"]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in streamed_groups(batches, keys):
            bounds = group_bounds(whole, keys)
            ids, weight, block = (whole.column(c).to_numpy() for c in ("node", "weight", "block"))
            low, high = whole.column("low").to_numpy(), whole.column("high").to_numpy()
            vector = whole.column("vector")
            totals = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                units = matrix(vector.slice(a, b - a))
                near = units @ units.T >= threshold
                np.fill_diagonal(near, False)
                if low[a] != high[a]:
                    near &= block[a:b, None] != block[None, a:b]
                totals.append(near @ weight[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(totals).astype(np.int64))], names=["node", "others"])

    count = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    compared = tasks.repartition(count, *keys).sortWithinPartitions(*keys).mapInArrow(per_batch, "node long, others long")
    return compared.groupBy("node").agg(F.sum("others").alias("others")).join(linked, "node")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row a row of ``vectors``."""
    rows, nodes = nodes_of(vectors)
    rows, nodes = stage(rows), stage(nodes)
    counts = stage(exact_counts(nodes, threshold_graph(nodes, threshold), threshold))
    known = nodes.select("node", "weight", "vec_id").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = known.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = known.join(smallest, "root").select("node", "component_id", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    used = rows.join(named, "node").select("vec_id", "n_links", "component_id")
    everything = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    unused = everything.where(~usable(everything)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return used.unionByName(unused).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
