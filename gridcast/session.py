"""Session defaults and the shared working folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str = "gridcast", master: str | None = None, **extra: str) -> SparkSession:
    """A session pinned to UTC with adaptive execution on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """All clock arithmetic here is UTC; local time is presentation only."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="gridcast-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder beneath the cluster's shared checkpoint folder.

    The folder is read from ``spark.checkpoint.dir``. Only a local master may
    fall back to a temporary folder: on a cluster it would be machine-local and
    lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach.")
        root = _local_root()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def spread(df, *columns: str):
    """Hash rows over the whole cluster before a generator multiplies them.

    A few small rows would otherwise be coalesced into one task that then
    emits all the generated rows. An explicit partition count is kept as it is.
    """
    spark = df.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(count, *columns)


def cut_lineage(df, path: str | None = None):
    """Write ``df`` to the shared folder (a fresh one, unless named) and read it back with a short lineage.

    A written table survives lost executors, which a cached or locally
    checkpointed frame does not.
    """
    path = path or shared_dir(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
