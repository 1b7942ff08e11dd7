"""The sources that go with a review's question: the handler's file and what it imports, as exact excerpts within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.operators.context import budgeted_reach, identifiers, owners
from corvid.operators.sweep import chosen_spans
from corvid.sources.imports import import_edges
from corvid.tables import stored

#: What stands between parts of a file, the characters of a file's head that come before its declarations, and most names of what
#: couldn't be shown.
MARKER, HEAD, UNAVAILABLE = "\n/* … omitted source … */\n", 1000, 100
#: A line that declares something, and its name.
_DECLARES = r"^\s*(?:(?:export|default|public|private|protected|internal|static|abstract|final|async|pub|sealed|readonly)\s+)*(?:class|interface|enum|record|struct|trait|type|function|def|fn|func|const|let|var)\s+(?:\([^)]*\)\s*)?([A-Za-z_$][\w$]*)"


def declarations(files: DataFrame) -> DataFrame:
    """(project, path, name, start, end): lines that declare a name, each up to the next such line (start from 0)."""
    lines = F.transform(F.split("content", "\n"), lambda x: F.struct(F.length(x).alias("size"), F.regexp_extract(x, _DECLARES, 1).alias("name")))
    by_file = Window.partitionBy("project", "path").orderBy("n")
    placed = files.select("project", "path", F.length("content").alias("whole"), F.posexplode(lines).alias("n", "line"))
    placed = placed.withColumn("start", F.coalesce(F.sum(F.col("line.size") + 1).over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    named = placed.filter(F.col("line.name") != "")
    return named.select("project", "path", F.col("line.name").alias("name"), "start", F.coalesce(F.lead("start").over(by_file), F.col("whole")).alias("end"))


def review_contexts(routes: DataFrame, files: DataFrame, edges: DataFrame | None = None, missing: DataFrame | None = None, most_files: int = 8, most_chars: int = 24_000, most_of_one: int = 6_000, depth: int = 6) -> DataFrame:
    """(project, route, files, unavailable, limitations) of each route.

    routes: project, route (unique in it), origin (path of the declaration) and handler (its source, may be null); files:
    project, path, language, content. files of the result: place, path, depth, source, truncated, best first.

    A route starts from the files that hold its handler's text, or where none does from its origin, and follows imports
    (import_edges unless given) within the budget. Files that share more names with the handler come first. A file that doesn't
    fit is shown in parts: the handler, its head, declarations of names that the handler uses, then the rest, up to its share. What was
    left out, isn't among the files or couldn't be followed is named, up to 100 names.
    """
    if edges is None or missing is None:
        edges, missing = (stored(x, "imports") for x in import_edges(files))
    where = F.struct("project", "path")
    key = F.struct("project", "route").alias("origin")
    cut = F.regexp_replace("handler", r"\n(?://|#|/\*) \.\.\. (?:truncated|\*/)?$", "")
    asked = stored(routes.select("project", "route", "origin", cut.alias("handler")), "routes")
    texts = files.select("project", "path", F.col("content").alias("body"))
    held = stored(owners(asked.filter("handler <> ''").select("project", F.struct("project", "route").alias("handler"), "origin", F.col("handler").alias("body")), texts, ["project"]), "owners")
    owned = held.select("project", F.col("handler").alias("origin"), where.alias("path"))
    alone = asked.select("project", key, F.struct("project", F.col("origin").alias("path")).alias("path")).filter("path.path IS NOT NULL").join(owned.select("origin"), "origin", "left_anti")
    starts = owned.unionByName(alone.select("project", "origin", "path")).select("origin", "path")
    named = files.select(where.alias("path"), F.explode(identifiers(F.col("content"))).alias("name"))
    wanted = stored(asked.select(key, F.explode(identifiers(F.coalesce("handler", F.lit("")))).alias("name")), "names")
    sizes = files.select(where.alias("path"), F.length("content").alias("size"))
    hops = edges.select(where.alias("path"), F.struct("project", F.col("target").alias("path")).alias("target"))
    taken, left_out = budgeted_reach(starts, sizes, hops, wanted, named, most_files, most_chars, most_of_one, depth)
    taken, left_out = stored(taken, "taken"), stored(left_out, "left-out")

    shown = taken.join(files.select(where.alias("path"), "content"), "path").join(asked.select(key, "handler"), "origin")
    at = F.when(F.col("handler") != "", F.instr("content", F.col("handler"))).otherwise(0)
    whole = shown.filter("NOT truncated").select("origin", "path", "place", "depth", F.col("content").alias("source"), "truncated")
    long = stored(shown.filter("truncated").select("origin", "path", "place", "depth", "chars", "content", "handler", at.alias("at")), "long")
    span = lambda df, priority, start, end: df.select("origin", "path", F.lit(priority).alias("priority"), start.cast("long").alias("start"), end.cast("long").alias("end"))
    size = F.length("content")
    spans = span(long.filter("at > 0"), 0, F.col("at") - 1, F.col("at") - 1 + F.length("handler"))
    spans = spans.unionByName(span(long, 1, F.lit(0), F.least(F.lit(HEAD), size))).unionByName(span(long, 3, F.lit(0), size))
    declared = declarations(files.join(long.select("path.project", "path.path").distinct(), ["project", "path"])).select(where.alias("path"), "name", "start", "end")
    met = long.select("origin", "path").join(declared, "path").join(wanted, ["origin", "name"])
    spans = spans.unionByName(span(met, 2, F.col("start"), F.col("end")))
    chosen = limited_spans(spans, long.select("origin", "path", "chars"), len(MARKER))
    pieces = chosen.groupBy("origin", "path").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    source = F.array_join(F.transform("spans", lambda x: F.substring("content", (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))), MARKER)
    parts = long.join(pieces, ["origin", "path"]).select("origin", "path", "place", "depth", source.alias("source"), F.lit(True).alias("truncated"))
    one = F.struct("place", F.col("path.path").alias("path"), "depth", "source", "truncated")
    context = whole.unionByName(parts).groupBy("origin").agg(F.sort_array(F.collect_list(one)).alias("files"))

    unseen = left_out.select("origin", F.col("path.path").alias("name")).unionByName(taken.select("origin", "path.project", "path.path").join(missing, ["project", "path"]).select("origin", "name"))
    names = unseen.distinct().groupBy("origin").agg(F.slice(F.sort_array(F.collect_set("name")), F.lit(1), F.lit(UNAVAILABLE)).alias("unavailable"))
    why = left_out.groupBy("origin").agg(F.collect_set("reason").alias("reasons"))
    said = held.groupBy(F.col("handler").alias("origin")).agg(F.max("ambiguous").alias("ambiguous"))
    out = asked.select(key).join(context, "origin", "left").join(names, "origin", "left").join(why, "origin", "left").join(said, "origin", "left")
    has = lambda reason: F.coalesce(F.array_contains("reasons", reason), F.lit(False))
    limits = F.array(
        F.when(has("budget"), f"Source budget reached ({most_files} files, {most_chars} characters)."), F.when(has("depth"), f"Imports deeper than {depth} weren't followed."),
        F.when(F.col("ambiguous").isNull(), "The file that holds the handler wasn't found."), F.when(F.col("ambiguous"), "Several files hold the handler's text."),
    )
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return out.select(
        "origin.project", "origin.route", none("files", context.schema["files"].dataType).alias("files"), none("unavailable", "array<string>").alias("unavailable"),
        F.filter(limits, lambda x: x.isNotNull()).alias("limitations"),
    )


def limited_spans(spans: DataFrame, limits: DataFrame, marker: int) -> DataFrame:
    """chosen_spans of each (origin, path) within its own limit, `chars`."""
    most = limits.agg(F.max("chars")).first()[0] or 0
    placed = chosen_spans(spans, ["origin", "path"], most, marker, ranked=True).join(limits, ["origin", "path"])
    left = F.col("chars") - F.col("before")
    return placed.filter(left > 0).select("origin", "path", "start", F.least("end", F.col("start") + left).alias("end"))
