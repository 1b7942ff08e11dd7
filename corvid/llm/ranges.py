"""Places and running sums over a whole table in a given order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.llm.shared import stored


def running(df: DataFrame, order: Sequence[Column], sums: Sequence[str] = (), rows_a_part: int = 50_000) -> DataFrame:
    """df with `nth` (1, 2, ... in the order) and, for each column c of sums, `before_c`: its sum over all earlier rows.

    Rows are dealt out by ranges of the order and written with the number of their range, so that a lost executor can't
    deal them anew. Ranges are counted and summed, the totals (a row a range) are run through once, and rows are
    numbered within their range. df should be cheap to read twice; the order should tell all rows apart, or those it
    doesn't stand in one range in any order. An empty table gives an empty result.
    """
    parts = df.count() // rows_a_part + 1
    ranged = stored(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), *(F.sum(c).alias(f"__{c}") for c in sums))
    earlier = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__range", *(F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in ("n", *sums)))
    own = Window.partitionBy("__range").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select("*", F.row_number().over(own).alias("__place"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__own_{c}") for c in sums))
    return placed.join(offsets, "__range").select(*(f"`{c}`" for c in df.columns), (F.col("__n") + F.col("__place")).alias("nth"), *((F.col(f"__{c}") + F.col(f"__own_{c}")).alias(f"before_{c}") for c in sums))
