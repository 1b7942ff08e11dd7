"""Reachability over mount graphs, and the scopes and handlers that apply to routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.operators.fixpoint import fixpoint
from corvid.operators.sweep import cut_into_blocks
from corvid.tables import dropped, stored


def mount_closure(roots: DataFrame, edges: DataFrame, budget: int = 10_000, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(reached, cycles) from roots (router, prefix) over edges (parent, child, prefix).

    reached: router, prefix and depth, a row for each way; cycles: parent, child and prefix where an edge leads back to
    a router on the way to it, which ends that way. A level is one join of the last level's ways with the edges on the
    parent, written to the shared folder. More than `budget` ways from one root raise an error: an unbounded graph
    is a mistake in the input, not a longer job. So do mounts nested more than `depth` deep, where it is given.
    """
    more = stored(edges.select("parent", "child", F.col("prefix").alias("more")), "edges")
    seed = roots.select("router", "prefix", F.array("router").alias("way"), F.lit(False).alias("back"))
    most, ways = budget * max(1, roots.count()), 0

    def step(last: DataFrame) -> DataFrame:
        up = last.filter("NOT back").select(F.col("router").alias("parent"), F.col("prefix").alias("base"), F.col("way").alias("was"))
        child = F.col("child")
        return up.join(more, "parent").select(child.alias("router"), F.concat("base", "more").alias("prefix"), F.concat("was", F.array(child)).alias("way"), F.array_contains("was", child).alias("back"))

    def within(level: int, rows: int) -> None:
        nonlocal ways
        if depth is not None and level > depth:
            raise ValueError(f"mounts are nested more than {depth} deep")
        ways += rows
        if ways > most:
            raise ValueError(f"roots reach more than {most} mounts together; the budget is {budget} a root")

    found = fixpoint(seed, step, None, "mounts", within)
    dropped(more)
    reached = found.filter("NOT back")
    widest = reached.groupBy(F.get("way", F.lit(0)).alias("root")).count().agg(F.max("count")).first()[0] or 0
    if widest > budget:
        raise ValueError(f"a root reaches {widest} mounts; the budget is {budget}")
    cycles = found.filter("back").select(F.element_at("way", -2).alias("parent"), F.col("router").alias("child"), "prefix")
    return reached.select("router", "prefix", F.col("round").alias("depth")), cycles


def root_routers(routers: DataFrame, edges: DataFrame) -> DataFrame:
    """Routers that nothing mounts."""
    return routers.join(edges.select(F.col("child").alias("router")).distinct(), "router", "left_anti")


def orphans(routers: DataFrame, reached: DataFrame) -> DataFrame:
    """Routers that no root reaches."""
    return routers.join(reached.select("router").distinct(), "router", "left_anti")


def route_sites(sites: DataFrame, reached: DataFrame) -> DataFrame:
    """Each route site under each prefix that its router is reached by (router, path -> full_path)."""
    return sites.join(reached.select("router", "prefix"), "router").withColumn("full_path", F.regexp_replace(F.concat("prefix", "path"), "/+", "/"))


def covering_scopes(routes: DataFrame, scopes: DataFrame, path: str = "path", scope: str = "scope", on: Sequence[str] = (), at: str | None = None) -> DataFrame:
    """Routes with each scope that is their path or a prefix of it at a slash.

    Rather than a join on startswith, which compares all pairs, a route is looked up by each of its own prefixes. `on`
    names columns that have to be equal too (the router). `at` names a column of both tables, the position: then only
    scopes declared before the route count, and the result has the scope's position as `<at>_of_scope`. A scope of "/"
    covers all."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    looked_up = routes.withColumn(scope, F.explode(F.array_distinct(F.concat(prefixes, F.array(F.lit("/"))) if at else prefixes)))
    if at is None:
        return looked_up.join(scopes, [*on, scope])
    return looked_up.join(scopes.withColumnRenamed(at, f"{at}_of_scope"), [*on, scope]).filter(F.col(f"{at}_of_scope") < F.col(at))


def later_handlers(events: DataFrame, scope: str, ordinal: str, route: Column, handler: Column, key: str) -> DataFrame:
    """Routes of `events` with the handlers registered after them in their scope: key, handlers (how many) and
    first_handler (the least key among them); routes without any are left out.

    Running aggregates from the end of the scope, not a join of all pairs, in blocks of a hot scope; rows of the same ordinal
    aren't after each other."""
    own = events.filter((route | handler) & F.col(scope).isNotNull()).select(scope, key, F.col(ordinal).alias("__at"), route.alias("__route"), F.when(handler, F.col(key)).alias("__handler"))
    found = _after(own, [scope]).filter("__route AND __n > 0")
    return found.select(key, F.col("__n").alias("handlers"), F.col("__least").alias("first_handler"))


def _after(rows: DataFrame, on: list[str], rows_a_block: int = 50_000) -> DataFrame:
    """rows (on, __at, __handler and others) with __n and __least: how many rows of their group with a handler have a greater
    position, and the least handler among them. Groups are cut into blocks of positions; a block adds what all later ones hold."""
    cuts, block = cut_into_blocks(rows, on, "__at", rows_a_block)
    placed = rows.join(cuts, on).withColumn("__block", F.coalesce(block(F.col("__at")), F.lit(0))).drop("__cuts")
    later = Window.partitionBy(*on).orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*on, "__block").agg(F.count("__handler").alias("n"), F.min("__handler").alias("least"))
    sums = sums.select(*on, "__block", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("__n_later"), F.min("least").over(later).alias("__least_later"))
    after = Window.partitionBy(*on, "__block").orderBy(F.desc("__at")).rangeBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("__n", F.count("__handler").over(after)).withColumn("__least", F.min("__handler").over(after))
    both = own.join(sums, [*on, "__block"])
    return both.select(*rows.columns, (F.col("__n") + F.col("__n_later")).alias("__n"), F.least("__least", "__least_later").alias("__least"))


def later_counts(routes: DataFrame, handlers: DataFrame, on: Sequence[str], at: str, rows_a_block: int = 50_000) -> DataFrame:
    """routes with `handlers`: how many handlers of the same `on` have a greater position."""
    on = list(on)
    row = F.struct(*(F.col(f"`{c}`") for c in routes.columns))
    own = routes.select(*on, F.col(at).alias("__at"), row.alias("__route"), F.lit(None).cast("int").alias("__handler"))
    both = own.unionByName(handlers.select(*on, F.col(at).alias("__at"), F.lit(1).alias("__handler")), allowMissingColumns=True)
    return _after(both, on, rows_a_block).filter("__route IS NOT NULL").select("__route.*", F.col("__n").cast("long").alias("handlers"))


def handler_pairs(routes: DataFrame, handlers: DataFrame, on: Sequence[str], at: str, where: Column | None = None, most: int | None = None, rows_a_block: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """(pairs, counted): each route with each handler of the same `on` whose position `at` is greater.

    routes and handlers have `on` and `at` and no other common names; a pair has `on`, the route's columns and the handler's,
    with `at` of the handler as `<at>_of_handler`. `where` is a further condition on a pair. Positions of each `on` are cut
    into blocks of about rows_a_block handlers: a route meets all handlers of later blocks by the number of the block alone,
    and those of its own block by comparing positions. So the join is by equality of `on` and block, the handlers of a hot scope lie in
    many tasks, and a route is repeated once for each block that it meets, not for each handler.

    Where a route has more than `most` later handlers it isn't paired: `counted` has those routes with `handlers`, how many
    there are (before `where`). Without `most` it is empty. Rows without a position meet nothing.
    """
    on = list(on)
    routes, handlers = routes.filter(F.col(at).isNotNull()), handlers.filter(F.col(at).isNotNull())
    if most is None:
        counted = routes.limit(0).withColumn("handlers", F.lit(0).cast("long"))
    else:
        sizes = later_counts(routes, handlers, on, at)
        counted, routes = sizes.filter(F.col("handlers") > most), sizes.filter(F.col("handlers") <= most).drop("handlers")
    cuts, block = cut_into_blocks(handlers, on, at, rows_a_block)
    theirs = handlers.withColumnRenamed(at, f"{at}_of_handler").join(cuts, on).withColumn("__block", block(F.col(f"{at}_of_handler"))).drop("__cuts")
    mine = routes.join(cuts, on).withColumn("__own", block(F.col(at))).withColumn("__block", F.explode(F.sequence("__own", F.size("__cuts")))).drop("__cuts")
    met = mine.join(theirs, [*on, "__block"]).filter((F.col("__block") > F.col("__own")) | (F.col(f"{at}_of_handler") > F.col(at))).drop("__block", "__own")
    return met if where is None else met.filter(where), counted


def error_handlers(routes: DataFrame, handlers: DataFrame) -> DataFrame:
    """(route, handler): the error handlers that a route's errors reach.

    routes: route, router, position, path, full_path; handlers: handler, router, position, scope (null: everything) and
    global (on the application itself). A router's own handlers count where they are declared after the route and their
    scope starts its path; the application's count for every route whose full path their scope starts. The latter are
    looked up by scope among all starts of the path, not compared with every route."""
    own = handlers.select("handler", "router", "position", "scope")
    pairs, _ = handler_pairs(routes.select("route", "router", "position", "path"), own, ["router"], "position", F.col("scope").isNull() | F.col("path").startswith(F.col("scope")))
    starts = F.transform(F.sequence(F.lit(0), F.length("full_path")), lambda n: F.substring("full_path", F.lit(1), n))
    everywhere = handlers.filter("global").select("handler", F.coalesce("scope", F.lit("")).alias("scope"))
    reached = routes.select("route", F.explode(starts).alias("scope")).join(everywhere, "scope")
    return pairs.select("route", "handler").unionByName(reached.select("route", "handler")).distinct()


def exception_handlers(raised: DataFrame, handlers: DataFrame, parents: DataFrame) -> DataFrame:
    """Each raised row (route, error) with the handler of its class or, failing that, of its nearest ancestor; of ancestors
    equally near the first by name. Rows that no class of theirs handles are left out.

    handlers: error, handler; parents: error, parent (a class's direct ones). Only distinct classes climb, one join a level,
    each way until it meets a handler; a way that comes back to a class ends there. Any depth is followed."""
    handled = stored(handlers.groupBy("error").agg(F.min("handler").alias("handler")), "handlers")
    up = stored(parents.select(F.col("error").alias("class"), F.col("parent").alias("__up")).filter("__up IS NOT NULL").distinct(), "edges")
    known = handled.select(F.col("error").alias("class"))

    def step(last: DataFrame) -> DataFrame:
        return last.join(known, "class", "left_anti").join(up, "class").select("error", F.col("__up").alias("class"))

    seed = raised.select("error").filter("error IS NOT NULL").distinct().select("error", F.col("error").alias("class"))
    climbed = fixpoint(seed, step, ["error", "class"], "exceptions")
    dropped(up)
    met = climbed.join(handled.select(F.col("error").alias("class"), "handler"), "class")
    nearest = met.groupBy("error").agg(F.min_by("handler", F.struct("round", "class")).alias("handler"))
    return raised.join(nearest, "error").select("route", "error", "handler")
