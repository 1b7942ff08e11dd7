"""The source context of a route: which file holds its handler, what that file reaches by imports, within a budget."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.tables import dropped, stored

#: Bytes of a gram, and how many grams in a row one is picked from: a text of GRAM + PICK - 1 bytes holds a picked one.
GRAM, PICK = 8, 16
#: Bits of the table that tells which grams are asked about; grams of texts that are sent at once.
BITS, ROWS = 24, 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _grams(raw: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of `width` bytes, the width in it."""
    if len(raw) < width:
        return np.zeros(0, np.uint64)
    out = np.full(len(raw) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x100000001B3) + raw[k : len(raw) - width + 1 + k]
    return _mixed(out)


def picked(text: bytes) -> np.ndarray:
    """The grams of a text that stand for it: of each PICK successive ones the least. Whatever a longer text holds before and
    after, it picks these too, as each is the least of a run that lies within this one."""
    grams = _grams(np.frombuffer(text, np.uint8), GRAM)
    if len(grams) < PICK:
        return np.zeros(0, np.uint64)
    least, span = grams, 1
    while span < PICK:
        step = min(span, PICK - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return np.unique(least)


def _width(size: int) -> int:
    """Of a needle too short to hold a picked gram: how many of its first bytes are looked up wherever they stand."""
    return next(w for w in (8, 4, 2, 1) if w <= size)


def _needle_grams(batches):
    for batch in batches:
        at, grams = [], []
        for k, text in enumerate(batch.column(1).cast(pa.large_binary())):
            raw = text.as_py()
            found = picked(raw)
            if not len(found):
                found = _grams(np.frombuffer(raw[: _width(len(raw))], np.uint8), _width(len(raw)))
            at.append(np.full(len(found), k))
            grams.append(found)
        none = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(at or none).astype(np.int64))), pa.array(np.concatenate(grams or none).astype(np.uint64).view(np.int64))], ["needle", "gram"])


def _text_grams(wanted, widths):
    """Of each text the grams that are asked about: picked ones, and those of short needles wherever they stand."""

    def run(batches):
        bits = wanted.value
        for batch in batches:
            at, grams, held = [], [], 0

            def rows():
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(grams).view(np.int64))], ["text", "gram"])

            for k, text in enumerate(batch.column(1).cast(pa.large_binary())):
                raw = text.as_py()
                parts = [picked(raw), *(np.unique(_grams(np.frombuffer(raw, np.uint8), w)) for w in widths)]
                found = np.unique(np.concatenate([p[_asked(bits, p)] for p in parts]))
                if len(found):
                    at.append(np.full(len(found), k))
                    grams.append(found)
                    held += len(found)
                if held >= ROWS:
                    yield rows()
                    at, grams, held = [], [], 0
            if held:
                yield rows()

    return run


def _asked(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    place = grams & np.uint64((1 << BITS) - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _bit_table(grams: DataFrame) -> np.ndarray:
    """A table of 2^BITS bits, one set for each gram: of fixed size, made by an aggregation over its 64-bit words."""
    place = F.col("gram").bitwiseAND(F.lit((1 << BITS) - 1))
    words = grams.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()  # at most 2^(BITS - 6) rows
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table.view(np.uint8)


def contained(needles: DataFrame, texts: DataFrame, on: Sequence[str] = (), needle: str = "needle", text: str = "text", body: str = "body") -> DataFrame:
    """(on, needle, text) for each text that holds a needle's body as a part of it, among those equal in `on`.

    needles: on, needle (its id) and body; texts: on, text (its id) and body; ids are unique. Null and empty needles are in
    no text. No pair of a needle and a text is compared unless the text holds the needle's rarest gram: texts are indexed by
    grams that are picked by their neighbourhood, so that a needle's picked grams are among those of any text which
    holds it; only grams of needles are indexed, known from a bit table of fixed size; of a needle's grams the one in the fewest texts
    gives its candidates; and these are checked by `contains`. Needles under GRAM + PICK - 1 bytes are looked up by
    their first bytes. Ids and grams pass shuffles, and texts once, to their candidates.
    """
    on, spark = list(on), needles.sparkSession
    asked = needles.filter(F.length(body) > 0).select(*on, F.col(needle).alias("__needle"), F.col(body).alias("__part"))
    kind = needles.schema[needle].dataType.simpleString()
    grams = stored(asked.select(F.col("__needle").alias("needle"), F.col("__part").alias("body")).mapInArrow(_needle_grams, f"needle {kind}, gram long"), "needle-grams")
    size = F.octet_length("__part")
    short = {_width(r.n) for r in asked.filter(size < GRAM + PICK - 1).select(F.least(size, F.lit(8)).alias("n")).distinct().collect()}  # at most 8 rows
    bits = spark.sparkContext.broadcast(_bit_table(grams.select("gram").distinct()))
    kind = texts.schema[text].dataType.simpleString()
    held = texts.filter(F.length(body) > 0).select(F.col(text).alias("text"), F.col(body).alias("body")).mapInArrow(_text_grams(bits, sorted(short)), f"text {kind}, gram long")
    postings = stored(held.join(grams.select("gram").distinct(), "gram", "left_semi"), "text-grams")
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    # a needle of which one gram is nowhere is nowhere
    rare = grams.join(counts, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct("texts", "gram")).alias("gram"), F.count_if(F.col("texts").isNull()).alias("lost")).filter("lost = 0")
    pairs = rare.select(F.col("needle").alias("__needle"), "gram").join(postings.select("gram", F.col("text").alias("__text")), "gram").drop("gram")
    named = pairs.join(asked, "__needle")
    bodies = texts.select(*(F.col(c).alias(f"__{c}_of_text") for c in on), F.col(text).alias("__text"), F.col(body).alias("__whole"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}_of_text")) for c in on]
    met = named.join(bodies, "__text").filter(F.contains("__whole", "__part"))
    for condition in same:
        met = met.filter(condition)
    return met.select(*on, F.col("__needle").alias(needle), F.col("__text").alias(text))


def owners(handlers: DataFrame, files: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """(on, handler, path, ambiguous): the files that hold a handler's text; its own file alone where that is one of them.

    handlers: on, handler (id), origin (a path) and body; files: on, path, body. ambiguous: several files hold it."""
    on = list(on)
    named = files.select(*on, F.struct(*on, "path").alias("file"), "body")
    found = contained(handlers.select(*on, "handler", "body"), named, on, "handler", "file").select(*on, "handler", F.col("file.path").alias("path"))
    met = found.join(handlers.select("handler", "origin"), "handler").withColumn("own", F.col("path").eqNullSafe(F.col("origin")))
    each = Window.partitionBy("handler")
    judged = met.withColumn("any", F.max("own").over(each)).withColumn("n", F.count(F.lit(1)).over(each))
    return judged.filter("own OR NOT any").select(*on, "handler", "path", (~F.col("any") & (F.col("n") > 1)).alias("ambiguous"))


def identifiers(body: Column) -> Column:
    """The distinct identifiers of a text."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1)))


def scored(pairs: DataFrame, asked: DataFrame, held: DataFrame) -> DataFrame:
    """pairs (origin, path, ...) with score: how many of the origin's names the file has. asked: origin, name; held: path, name; each
    pair once."""
    met = pairs.select("origin", "path").distinct().join(asked.hint("merge"), "origin").join(held.hint("merge"), ["path", "name"])
    return pairs.join(met.groupBy("origin", "path").agg(F.count(F.lit(1)).alias("score")).hint("merge"), ["origin", "path"], "left").fillna(0, ["score"])


def budgeted_reach(origins: DataFrame, files: DataFrame, edges: DataFrame, asked: DataFrame | None = None, held: DataFrame | None = None, most_files: int = 8, most_chars: int = 24_000, most_of_one: int = 6_000, depth: int = 6) -> tuple[DataFrame, DataFrame]:
    """(taken, left_out): what each origin reaches along edges, nearest first, within a budget of its own.

    origins: origin and path, a row for each file that it starts from; files: path and size (characters); edges: path and
    target; asked (origin, name) and held (path, name) put the files of a level in order, see scored.

    All origins go forward together, a level at a time. An origin's new files of a level are ordered by score, the highest
    first, and path. Each gets up to most_of_one characters: of what is left at depth 0, of an even share of it among the files
    that may still come further on. A file met when nothing is left, or when the origin has most_files, is left out; so is one
    that isn't in `files`, or lies deeper than `depth`. What is left out isn't followed; a file counts at its first level.

    taken: origin, path, depth, place (1, 2, ... of its origin), chars, truncated. left_out: origin, path, reason (budget, depth
    or unknown). A level costs a join of its files with the edges, an anti-join with what its origins have met, and a fold over at
    most most_files rows of an origin; what is known is a row for each origin and file in the shared folder. Joins are by sorting, so
    that no level is broadcast through the driver. Null paths are ignored, and repeated rows count once.
    """
    # read once a level, so they are written once
    size = stored(files.filter("path IS NOT NULL").groupBy("path").agg(F.max("size").cast("long").alias("size")), "sizes")
    hops = stored(edges.select("path", "target").filter("target IS NOT NULL").distinct(), "hops")
    if asked is not None and held is not None:
        asked, held = stored(asked.select("origin", "name").distinct(), "asked"), stored(held.select("path", "name").distinct(), "held")
    placed = f"array<struct<path:{size.schema['path'].dataType.simpleString()},place:int,chars:bigint,truncated:boolean>>"

    def put(state, f, level: int):
        """One more file of an origin: what it gets of what is left."""
        left, room = F.lit(most_chars).cast("long") - state["spent"], F.lit(most_files) - state["used"]
        share = F.least(F.lit(most_of_one).cast("long"), left if level == 0 else F.floor(left / F.greatest(F.lit(1), room)).cast("long"))
        fits, chars = (room > 0) & (left > 0), F.least(f["size"], share)
        one = F.struct(f["path"].alias("path"), (state["used"] + 1).alias("place"), chars.alias("chars"), (chars < f["size"]).alias("truncated"))
        more = F.struct((state["used"] + 1).alias("used"), (state["spent"] + chars).alias("spent"), F.concat(state["out"], F.array(one)).alias("out"))
        return F.when(fits, more).otherwise(state)

    def settled(candidates: DataFrame, level: int) -> DataFrame:
        """Rows (origin, path, depth, why, place, chars, truncated, used, spent) of candidates (origin, path, used, spent)."""
        known = candidates.join(size.hint("merge"), "path", "left")
        known = known.withColumn("score", F.lit(0)) if asked is None or held is None else scored(known, asked, held)
        order = Window.partitionBy("origin").orderBy(F.desc("score"), "path")
        first = known.filter("size IS NOT NULL").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most_files)
        line = F.sort_array(F.collect_list(F.struct("n", "path", "size")))
        start = F.struct(F.max("used").alias("used"), F.max("spent").alias("spent"), F.array().cast(placed).alias("out"))
        after = first.groupBy("origin").agg(line.alias("line"), start.alias("start")).select("origin", F.aggregate("line", F.col("start"), lambda state, f: put(state, f, level)).alias("s"))
        got = after.select("origin", F.explode("s.out").alias("o"), F.col("s.used").alias("used"), F.col("s.spent").alias("spent")).select("origin", "o.*", "used", "spent")
        met = known.select("origin", "path", "size").join(got.hint("merge"), ["origin", "path"], "left")
        why = F.when(F.col("size").isNull(), "unknown").when(F.col("place").isNull(), "budget")
        return met.select("origin", "path", F.lit(level).alias("depth"), why.alias("why"), "place", "chars", "truncated", "used", "spent")

    nothing = [F.lit(0).alias("used"), F.lit(0).cast("long").alias("spent")]
    levels = [stored(settled(origins.select("origin", "path").filter("path IS NOT NULL").distinct().select("origin", "path", *nothing), 0), "reach")]
    for level in range(1, depth + 2):
        last, met = levels[-1].filter("why IS NULL"), reduce(DataFrame.unionByName, levels).select("origin", "path")
        reached = last.select("origin", "path", "used", "spent").join(hops.hint("merge"), "path").groupBy("origin", F.col("target").alias("path")).agg(F.max("used").alias("used"), F.max("spent").alias("spent"))
        fresh = reached.join(met.hint("merge"), ["origin", "path"], "left_anti")
        if level <= depth:
            levels.append(stored(settled(fresh, level), "reach"))
            if levels[-1].isEmpty():
                break
        else:
            levels.append(fresh.select("origin", "path", F.lit(level).alias("depth"), F.lit("depth").alias("why"), *(F.lit(None).cast(levels[0].schema[c].dataType).alias(c) for c in ("place", "chars", "truncated")), "used", "spent"))
    if len(levels) > depth + 1:
        levels[-1] = stored(levels[-1], "reach")
    for spent in (size, hops, *(x for x in (asked, held) if x is not None and asked is not None and held is not None)):
        dropped(spent)
    found = reduce(DataFrame.unionByName, levels)
    return found.filter("why IS NULL").select("origin", "path", "depth", "place", "chars", "truncated"), found.filter("why IS NOT NULL").select("origin", "path", F.col("why").alias("reason"))
