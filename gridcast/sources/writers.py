"""Sinks: protected writes, source landing and resumable run storage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridcast.functions.vocabulary import INIT, LEAD, SOURCE, STATION, TS
from gridcast.sources.readers import tag_source
from gridcast.sources.schedule import missing_leads


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def refuse_existing(spark: SparkSession, paths: Mapping[str, str], overwrite: bool) -> None:
    """Fail before any work when an output is present and may not be replaced."""
    present = [] if overwrite else [p for p in paths.values() if exists(spark, p)]
    if present:
        raise FileExistsError(f"{present[0]} already exists; allow overwrite to replace it.")


def write_table(df: DataFrame, path: str, overwrite: bool = False, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> str:
    """Parquet through Spark's committer; rows sorted inside files only."""
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    writer = out.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> str:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> str:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)
    return path


def land_source(rows: DataFrame, name: str, start, end) -> DataFrame:
    """Contract of every landed source: required columns, the window, exact duplicates removed, source tagged."""
    missing = sorted({STATION, TS} - set(rows.columns))
    if missing:
        raise ValueError(f"Rows of {name} cannot land: {missing} omitted.")
    inside = rows.filter((F.col(TS) >= start) & (F.col(TS) < end))
    return tag_source(inside.distinct(), name)


def append_missing_leads(planned: DataFrame, fetched: DataFrame, path: str) -> str:
    """Append only the (run, lead) rows that are not stored yet, so an interrupted load can be repeated."""
    spark = fetched.sparkSession
    keys = (SOURCE, STATION, INIT, LEAD)
    wanted = planned.select(*keys)
    try:
        wanted = missing_leads(wanted, spark.read.parquet(path), keys)
    except AnalysisException:
        pass
    # Listing a table while appending to it is safe: the files to read are fixed when the plan is built.
    fetched.join(wanted, list(keys), "left_semi").write.mode("append").parquet(path)
    return path
