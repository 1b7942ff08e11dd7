"""Rescans as a stream: files that come are hashed, compared with what is known, and reported.

Spark's file streams read a path once: an edited file is seen if it comes under a new path, such as a folder of each release.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators.diff import snapshot_diff
from corvid.sources.scan import decoded
from corvid.tables import deleted

STATE = "path string, hash string"


def file_stream(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, hash) of files as they appear under root."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return raw.select("path", F.sha2(decoded(F.col("content")), 256).alias("hash")).filter("hash IS NOT NULL")


#: Batches after which the state is written as one table again.
COMPACTED = 16


def _state(spark: SparkSession, known: str, number: int) -> tuple[DataFrame | None, int, list[str]]:
    """(latest path and hash before a batch, batches that it was read from, folders older than its base)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(known)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):  # any other failure to read is an error
        return None, 0, []
    held = [s.getPath() for s in fs.listStatus(where)]
    whole = {tuple(p.getName().split("=")): p.toString() for p in held if "=" in p.getName() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}
    base = max((int(n) for kind, n in whole if kind == "base" and int(n) <= number), default=-1)
    batches = [int(n) for kind, n in whole if kind == "batch" and max(base, 0) <= int(n) < number]
    read = [(n, whole["batch", str(n)]) for n in batches] + ([(-1, whole["base", str(base)])] if base >= 0 else [])
    old = [p for (kind, n), p in whole.items() if int(n) < base]
    if not read:
        return None, 0, old
    rows = [spark.read.schema(STATE).parquet(p).withColumn("batch", F.lit(n)) for n, p in read]
    return reduce(DataFrame.unionByName, rows).groupBy("path").agg(F.max_by("hash", "batch").alias("hash")), len(batches), old


def watch(stream: DataFrame, known: str, checkpoint: str, on_change: Callable[[DataFrame], None], compacted: int = COMPACTED):
    """Start a query that hands each batch's (path, kind) to on_change and keeps the state as Parquet tables under `known`.

    A batch is written under its own number, so that a batch that runs again replaces itself. After `compacted` batches the latest
    hash of every path is written as one table, a base, from which later batches are read, and what is older is
    deleted; so a batch reads one base and fewer than `compacted` batches, however long the query has run."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        before, batches, old = _state(spark, known, number)
        for folder in old:
            deleted(spark, folder)
        if batches >= compacted:
            before = written_over(before, f"{known}/base={number}")
        seen = before.join(df.select("path"), "path", "left_semi") if before is not None else df.limit(0)
        on_change(snapshot_diff(seen, df, "path", "hash"))
        df.write.mode("overwrite").parquet(f"{known}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written_over(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(STATE).parquet(path)
