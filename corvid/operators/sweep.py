"""Intervals and points: the innermost scope of a place, and spans chosen by priority."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Most blocks of one group; most spans of a group that are compared with each other in one row.
BLOCKS, FEW = 256, 32


def cut_into_blocks(rows: DataFrame, on: Sequence[str], at: str, rows_a_block: int) -> tuple[DataFrame, Callable[[Column], Column]]:
    """(cuts, block): for each group of `on` the positions at which it is cut into blocks of about rows_a_block rows, and the
    number of the block of a position by the column __cuts. A small group is one block, without cuts.

    Groups are counted, and only of those larger than a block, which are few, cuts are taken from a mergeable quantile sketch,
    so that a hot group is summed up by many tasks. Cuts decide where rows meet, never which do. Positions are numbers or
    timestamps; those equal to a cut are in the block before it."""
    on = list(on)
    shares = [k / BLOCKS for k in range(1, BLOCKS)]
    sizes = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    hot = rows.join(sizes.filter(F.col("__n") > rows_a_block).select(*on), on, "left_semi").groupBy(*on).agg(F.percentile_approx(at, shares, 10_000).alias("__q"))
    every = F.greatest(F.lit(1), F.ceil(F.lit(BLOCKS) * rows_a_block / F.col("__n"))).cast("int")
    some = F.array_distinct(F.filter("__q", lambda q, k: (k + 1) % every == 0))
    cuts = sizes.join(hot, on, "left").select(*on, F.coalesce(some, F.array().cast(f"array<{rows.schema[at].dataType.simpleString()}>")).alias("__cuts"))
    return cuts, lambda x: F.size(F.filter("__cuts", lambda q: q < x))


def innermost(points: DataFrame, intervals: DataFrame, on: Sequence[str], at: str = "at", start: str = "start", end: str = "end", rows_a_block: int = 50_000) -> DataFrame:
    """points with the columns of the innermost interval that covers them (start <= at < end) in their group of `on`, or nulls.

    Intervals of a group must lie within each other or apart, as scopes do; empty ones cover nothing, and of equal ones the
    first by its other columns is the outer one. One sweep, no range join: starts, ends and points are sorted together and
    their running sum is the depth. The scope that is open at depth d is the last start that led to d, so the
    top of the stack is the last start among the rows of the same depth.

    Groups are cut into blocks. A block's sums and last starts are carried into later blocks, so a hot group is swept by many
    tasks. Points without a position or a group are in no interval. Other columns of points and intervals must not share names.
    """
    on = list(on)
    somewhere = F.lit(True)
    for c in (*on, at):
        somewhere = somewhere & F.col(c).isNotNull()
    more = [c for c in intervals.columns if c not in (*on, start, end)]
    row = F.struct(*(F.col(f"`{c}`") for c in (start, end, *more)))
    real = intervals.filter(F.col(start) < F.col(end)).select(*on, row.alias("__scope"))
    # at one position ends come first, then starts, the wider before the narrower, then points
    event = lambda df, at, kind, change, *rest: df.select(*on, at.alias("__at"), F.lit(kind).alias("__kind"), F.lit(change).alias("__change"), *rest)
    scope = F.col("__scope")
    opened = event(real, scope[start], 1, 1, scope)
    closed = event(real, scope[end], 0, -1, F.lit(None).cast(opened.schema["__scope"].dataType).alias("__scope"))
    asked = event(points.filter(somewhere), F.col(at), 2, 0, F.struct(*(F.col(f"`{c}`") for c in points.columns)).alias("__point"))
    events = opened.unionByName(closed).unionByName(asked, allowMissingColumns=True)
    cuts, block = cut_into_blocks(events.select(*on, "__at"), on, "__at", rows_a_block)
    events = events.join(cuts, on).withColumn("__block", block(F.col("__at"))).drop("__cuts")
    sums = events.groupBy(*on, "__block").agg(F.sum("__change").alias("__sum"))
    before = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(Window.partitionBy(*on).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    order = ["__at", "__kind", F.desc(scope[end]), *(scope[c] for c in more)]
    within = Window.partitionBy(*on, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = events.join(before, [*on, "__block"]).withColumn("__depth", F.col("__base") + F.sum("__change").over(within)).drop("__base")
    # ends carry no scope, so the last scope met at a depth is the one that opened it last
    level = Window.partitionBy(*on, "__block", "__depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("__own", F.last(scope, ignorenulls=True).over(level)).withColumn("__nth", F.count(F.lit(1)).over(level))
    last = placed.groupBy(*on, "__block", "__depth").agg(F.max_by("__own", "__nth").alias("__left"))
    earlier = Window.partitionBy(*on, "__depth").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("__carried", F.last("__left", ignorenulls=True).over(earlier)).drop("__left")
    met = placed.filter("__kind = 2").join(carried, [*on, "__block", "__depth"])
    found = F.when(F.col("__depth") > 0, F.coalesce("__own", "__carried"))
    out = met.select("__point", found.alias("__scope")).select("__point.*", *(F.col(f"__scope.`{c}`").alias(c) for c in (start, end, *more)))
    lost = points.filter(~somewhere)
    return out.unionByName(lost, allowMissingColumns=True)


def dyadic(start: Column, end: Column, bits: int) -> Column:
    """The blocks (level, number) of 2^level places that make up the places from start to end - 1, at most two a level."""
    levels = F.sequence(F.lit(0), F.lit(bits))

    def blocks(k):
        low = F.call_function("shiftright", start + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
        high = F.call_function("shiftright", end, k)
        node = lambda which, number: F.when((low < high) & (which % 2 == 1), F.struct(k.alias("level"), number.alias("number")))
        return F.array(node(low, low), node(high, high - 1))

    return F.filter(F.flatten(F.transform(levels, blocks)), lambda b: b.isNotNull())


def best_covers(points: DataFrame, intervals: DataFrame, on: Sequence[str], at: str, best: str, start: str = "start", end: str = "end", bits: int = 32) -> DataFrame:
    """points with the least `best` of the intervals that cover them (start <= at < end), null where none does.

    Intervals may overlap in any way. Each is cut into dyadic blocks, of which only the best of a block is kept; a point looks
    up the bits + 1 blocks that hold it. Equality joins alone, and n log n rows. Positions are from 0 to 2^bits - 1."""
    on = list(on)
    block = F.explode(dyadic(F.col(start).cast("long"), F.col(end).cast("long"), bits)).alias("__block")
    tops = intervals.filter(F.col(start) < F.col(end)).select(*on, best, block).groupBy(*on, "__block").agg(F.min(best).alias(best))
    place = F.col(at).cast("long")
    holding = F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", place, k).alias("number")))
    looked = points.select(*on, at).distinct().withColumn("__block", F.explode(holding))
    found = looked.join(tops, [*on, "__block"]).groupBy(*on, at).agg(F.min(best).alias(best))
    return points.join(found, [*on, at], "left")


def chosen_spans(spans: DataFrame, on: Sequence[str], limit: int, marker: int = 0, start: str = "start", end: str = "end", priority: str = "priority", bits: int = 32, ranked: bool = False) -> DataFrame:
    """(on, start, end) of the parts of a text that a budget of `limit` characters goes to.

    Spans are served by priority, length and start; a span gives only what earlier ones didn't take, in fragments from left
    to right, and each fragment but the first costs `marker` more. The fragment in which the budget ends is cut there. Empty
    and null spans and those of a null group give nothing; of spans equal in all three any is the same. With `ranked` the result has `before` too, what
    was spent before a fragment, and fragments aren't cut short, so that a caller may apply limits of its own.

    Between two successive ends of spans a text belongs to one span, the best that covers it; pieces of one span that follow
    each other are a fragment; the budget is a running sum over fragments. Spans are dealt out once by their group: one of
    up to FEW spans is a row with an array of them, in which owners are found; only spans of larger groups go
    through best_covers, with its rows for each block of places.
    """
    on = list(on)
    somewhere = (F.col(start) < F.col(end)) & F.col(start).isNotNull()
    for c in on:
        somewhere = somewhere & F.col(c).isNotNull()
    real = spans.filter(somewhere).select(*on, F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"), F.col(priority).alias("priority"))
    real = real.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*on)))
    few, many = _owned_within_rows(real.filter(F.col("__n") <= FEW), on), _owned_by_blocks(real.filter(F.col("__n") > FEW).drop("__n").distinct(), on, bits)
    paid = _paid(few, on, limit, marker).unionByName(_paid(many, on, limit, marker))
    if ranked:
        return paid.select(*on, "start", "end", "before")
    return paid.select(*on, "start", F.least("end", F.col("start") + limit - F.col("before")).alias("end"))


def _owned_within_rows(real: DataFrame, on: list[str]) -> DataFrame:
    """(on, at, next, rank): the stretches between ends of spans with their best span, of small groups, each in one row."""
    rank = F.struct("priority", (F.col("end") - F.col("start")).alias("length"), F.col("start").alias("from"))
    groups = real.groupBy(*on).agg(F.sort_array(F.collect_set(rank)).alias("__spans"))
    places = F.array_distinct(F.flatten(F.transform("__spans", lambda s: F.array(s["from"], s["from"] + s["length"]))))

    def piece(at: Column, all_places: Column) -> Column:
        best = F.get(F.filter("__spans", lambda s: (s["from"] <= at) & (at < s["from"] + s["length"])), F.lit(0))
        return F.struct(at.alias("at"), F.array_min(F.filter(all_places, lambda x: x > at)).alias("next"), best.alias("rank"))

    # bound to a name, so that the places aren't found again for each of them
    pieces = F.transform(F.array(places), lambda p: F.transform(p, lambda at: piece(at, p)))[0]
    return groups.select(*on, F.inline(pieces)).filter("rank IS NOT NULL")


def _owned_by_blocks(real: DataFrame, on: list[str], bits: int) -> DataFrame:
    """(on, at, next, rank) as _owned_within_rows has them, of groups of any size."""
    rank = F.struct("priority", (F.col("end") - F.col("start")).alias("length"), F.col("start").alias("from"))
    of_rank = real.withColumn("rank", rank)
    group = Window.partitionBy(*on)
    edges = real.select(*on, F.explode(F.array("start", "end")).alias("at")).distinct().withColumn("next", F.lead("at").over(group.orderBy("at"))).filter("next IS NOT NULL")
    return best_covers(edges, of_rank, on, "at", "rank", bits=bits).filter("rank IS NOT NULL")


def _paid(owned: DataFrame, on: list[str], limit: int, marker: int) -> DataFrame:
    """(on, start, end, before): the fragments that the budget reaches, uncut, with what was spent before each."""
    group = Window.partitionBy(*on)
    by_place = group.orderBy("at")
    fresh = F.lag("rank").over(by_place).eqNullSafe(F.col("rank")) & F.lag("next").over(by_place).eqNullSafe(F.col("at"))
    numbered = owned.withColumn("__new", (~fresh).cast("int")).withColumn("__run", F.sum("__new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*on, "__run").agg(F.min("rank").alias("rank"), F.min("at").alias("start"), F.max("next").alias("end"))
    served = group.orderBy("rank", "start")
    cost = F.sum(F.col("end") - F.col("start") + marker).over(served.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("before", F.coalesce(cost, F.lit(0))).filter(F.col("before") < limit)
