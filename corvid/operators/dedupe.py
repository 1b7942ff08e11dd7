"""Choosing one row of a key, and telling equal names apart."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.operators.sweep import cut_into_blocks


def evidence_score(n_responses: Column, n_parameters: Column, has_body: Column, n_gaps: Column, weights: tuple[int, int, int] = (2, 1, 2)) -> Column:
    """How well a route candidate is proven. weights: of responses, parameters and a body; Go packs take (3, 2, 4)."""
    r, p, b = weights
    return r * n_responses + p * n_parameters + b * has_body.cast("int") - n_gaps


def keep_best(df: DataFrame, keys: Sequence[str], score: Column, ordinal: Column) -> DataFrame:
    """Of each key the row with the highest score, of equal ones the first by ordinal.

    An aggregation rather than a window: rows are combined before the shuffle, so a hot key costs a row a task."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.withColumn("__score", -score).withColumn("__at", ordinal).groupBy(*keys).agg(F.min_by(row, F.struct("__score", "__at")).alias("__row")).select("__row.*")


def first_wins(df: DataFrame, keys: Sequence[str], ordinal: Column) -> DataFrame:
    """Of each key the first row by ordinal."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.withColumn("__at", ordinal).groupBy(*keys).agg(F.min_by(row, "__at").alias("__row")).select("__row.*")


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, rows_a_block: int = 50_000) -> DataFrame:
    """df with `out`, the place (1, 2, ...) of each row among those of its keys in the given order.

    The first of `order` is a number or a time. By it the rows of a hot key are cut into blocks, which are counted and then
    numbered each in a task of its own; a block starts where those before it end. Null keys are a key; null positions
    come first."""
    names = [f"__k{n}" for n in range(len(keys))]
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    marked = df.select(*(F.struct(F.col(f"`{k}`").alias("k")).alias(n) for k, n in zip(keys, names)), row.alias("__row"), *(c.alias(f"__o{n}") for n, c in enumerate(order)))
    cuts, block = cut_into_blocks(marked, names, "__o0", rows_a_block)
    # left joins, whose left side Spark never broadcasts, however small its files are
    marked = marked.join(cuts, names, "left").withColumn("__block", F.coalesce(block(F.col("__o0")), F.lit(0))).drop("__cuts")
    earlier = Window.partitionBy(*names).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy(*names, "__block").agg(F.count(F.lit(1)).alias("__n")).select(*names, "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    own = Window.partitionBy(*names, "__block").orderBy(*(f"__o{n}" for n in range(len(order))))
    return marked.withColumn("__at", F.row_number().over(own)).join(starts, [*names, "__block"], "left").select("__row.*", (F.col("__start") + F.col("__at")).alias(out))


def duplicates(df: DataFrame, keys: Sequence[str], ordinal: Column) -> DataFrame:
    """The rows that first_wins drops: what a pack reports as duplicate routes."""
    return placed(df, keys, [ordinal], "__nth").filter("__nth > 1").drop("__nth")


def numbered_names(df: DataFrame, name: str, ordinal: Sequence[Column], out: str, within: Sequence[str] = ()) -> DataFrame:
    """The nth row of a name gets name_n; the first keeps the name."""
    n = F.col("__nth")
    return placed(df, [*within, name], ordinal, "__nth").withColumn(out, F.when(n > 1, F.concat(F.col(name), F.lit("_"), n.cast("string"))).otherwise(F.col(name))).drop("__nth")


def free_names(names: Sequence[str]) -> list[str]:
    """Names told apart: the first of equal ones keeps its name, later ones get the first suffix from _2 on that gives a
    name which neither stands anywhere in the list nor was given before."""
    reserved, following, out = set(names), {}, []
    for name in names:
        new = name
        if name in following:
            # what was taken once stays taken, so a name's numbers only go up
            at = next(n for n in itertools.count(following[name]) if f"{name}_{n}" not in reserved)
            new, following[name] = f"{name}_{at}", at + 1
        else:
            following[name] = 2
        reserved.add(new)
        out.append(new)
    return out


def unique_names(df: DataFrame, group: str, name: str, ordinal: str, out: str, rows_a_block: int = 50_000) -> DataFrame:
    """free_names within each group in the order of ordinal, a number or a time; null ordinals come first, a null name stays.

    A suffixed name can be that of one name only, so a name's kth later row gets the kth number from 2 on which no name of
    the group shows. Before the jth of the numbers that are taken, n, lie n - 1 - j free ones; so later rows by k and taken
    numbers by that are put in one order, and a row's place in it, plus one, is its number. Hot names are placed by blocks."""
    g, n, k = F.col("__g"), F.col("__name"), F.col("__k")
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    marked = df.select(F.col(f"`{group}`").alias("__g"), F.col(f"`{name}`").alias("__name"), F.col(f"`{ordinal}`").alias("__o"), row.alias("__row"))
    nth = placed(marked, ["__g", "__name"], [F.col("__o")], "__nth", rows_a_block)
    shown = marked.select(g, F.regexp_extract(n, r"(?s)^(.*)_([1-9][0-9]{0,17})$", 1).alias("__name"), F.regexp_extract(n, r"_([1-9][0-9]{0,17})$", 1).alias("__n"))
    shown = shown.filter("__n <> ''").select(g, n, F.col("__n").cast("long").alias("__n")).filter("__n >= 2").distinct()
    taken = placed(shown, ["__g", "__name"], [F.col("__n")], "__j", rows_a_block).select(g, n, (F.col("__n") - 1 - F.col("__j")).alias("__k"), F.lit(1).alias("__taken"))
    later = nth.filter(n.isNotNull() & (F.col("__nth") > 1)).select(g, n, (F.col("__nth") - 1).cast("long").alias("__k"), F.lit(0).alias("__taken"), "__row")
    both = later.unionByName(taken, allowMissingColumns=True)
    at = placed(both, ["__g", "__name"], [k, F.col("__taken")], "__at", rows_a_block).filter("__taken = 0")
    new = at.select("__row.*", F.concat(n, F.lit("_"), (F.col("__at") + 1).cast("string")).alias(out))
    kept = nth.filter(n.isNull() | (F.col("__nth") == 1)).select("__row.*", n.alias(out))
    return kept.unionByName(new)
