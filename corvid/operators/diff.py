"""Snapshots of scans: what was added, changed and removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, kind) of each key that was added, changed or removed: one full outer join; unchanged keys are left out."""
    a = previous.select(F.col(key).alias("__k"), F.col(fingerprint).alias("__a"), F.lit(True).alias("__was"))
    b = current.select(F.col(key).alias("__j"), F.col(fingerprint).alias("__b"), F.lit(True).alias("__is"))
    both = a.join(b, F.col("__k") == F.col("__j"), "full_outer")
    kind = F.when(F.col("__was").isNull(), "added").when(F.col("__is").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return both.select(F.coalesce("__k", "__j").alias(key), kind.alias("kind")).filter("kind IS NOT NULL")


def affected(diff: DataFrame, key: str) -> DataFrame:
    """Keys to analyse again: added and changed ones."""
    return diff.filter(F.col("kind").isin("added", "changed")).select(key)


def shared(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys that both snapshots have, each once."""
    return current.select(key).join(previous.select(key), key, "left_semi").distinct()


def listed(diff: DataFrame, key: str) -> DataFrame:
    """(kind, keys): the keys of each kind of change, in the order of their bytes. A report: a kind's keys are one row."""
    return diff.groupBy("kind").agg(F.sort_array(F.collect_set(key)).alias("keys"))


def left_over(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys of the previous snapshot that the current lacks."""
    return previous.select(key).join(current.select(key), key, "left_anti").distinct()
