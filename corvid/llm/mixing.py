"""Mixing sources to target weights: random keys, ranges of keys within each source, prefix sums of sizes, exact cuts.

DataFrame functions only. A document's key is a hash, so equal ranges of keys are equal parts of a source without any
sampling, and a hot source is many ranges, each a group of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.llm.ranges import running
from corvid.llm.shared import stored, words

#: Bits of a document's key, and the rows that a range of keys holds about.
KEY_BITS, ROWS_A_RANGE = 60, 500
#: A table of cuts of up to so many sources is broadcast (some 10 MB); a larger one is joined by a shuffle, salted.
FEW_SOURCES, SALTS = 100_000, 64
#: Between a word and the white space after it.
_AFTER_WORD = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def _group(source: Column) -> Column:
    """Sources as join keys, null last in their order."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def _keyed(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """group, size, key and tie of a row. Rows without an id are told apart by their text."""
    text, tie = F.col(text_col).cast("string"), F.xxhash64(F.col(text_col).cast("string"))
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("~"), tie.cast("string")))
    key = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, KEY_BITS // 4), 16, 10).cast("long")
    return [_group(F.col(source_col)).alias("group"), F.size(words(text)).cast("long").alias("size"), key.alias("key"), tie.alias("tie")]


def targets(sources: DataFrame, weights: Sequence[float] | DataFrame = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(group, source_size, target) from (group, source_size): each source's part of share * all sizes by its weight.

    weights: repeated along the sources in their order, or a table (source, weight); sources it lacks get nothing. No
    target is above most * source_size: what is cut off goes to the others by weight until none is above. That ends at
    one level, target = min(level * weight, cap), found where sources are sorted by cap / weight: the level that is
    left by the first k capped sources is the right one for the first source which isn't above its cap.
    """
    if isinstance(weights, DataFrame):
        given = weights.select(_group(F.col("source")).alias("group"), F.col("weight").cast("double").alias("w")).filter("w > 0").groupBy("group").agg(F.max("w").alias("w"))
        weighed = sources.join(given, "group", "left").select("group", "source_size", F.coalesce("w", F.lit(0.0)).alias("w"))
    else:
        cycle = F.array(*(F.lit(float(w)) for w in weights))
        weighed = running(sources, [F.col("group")]).select("group", "source_size", F.get(cycle, ((F.col("nth") - 1) % len(weights)).cast("int")).alias("w"))
    weighed = stored(weighed.withColumn("cap", most * F.col("source_size")), "mix-weights")
    total, weight = weighed.agg(F.sum("source_size"), F.sum("w")).first()
    asked = share * (total or 0)
    sorted_ = running(weighed.filter("w > 0").withColumn("ratio", F.col("cap") / F.col("w")), [F.col("ratio"), F.col("group")], ["cap", "w"])
    level = (F.lit(asked) - F.col("before_cap")) / (F.lit(float(weight or 0)) - F.col("before_w"))
    found = sorted_.filter(level * F.col("w") <= F.col("cap")).agg(F.min_by(level, "nth")).first()[0]
    target = F.col("cap").cast("double") if found is None else F.least(F.lit(found) * F.col("w"), F.col("cap").cast("double"))
    return weighed.select("group", "source_size", F.when(F.col("w") > 0, target).otherwise(0.0).alias("target"))


def _decided(docs: DataFrame, weights, share: float, most: int, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Rows equal in id and text as one (copies), with source_size, target, whole copies (epochs) and words of one more (cut)."""
    rows = docs.select(F.col(id_col).alias("id"), *_keyed(docs, seed, id_col, text_col, source_col))
    rows = stored(rows.groupBy("id", "group", "size", "key", "tie").agg(F.count(F.lit(1)).alias("copies")), "mix-rows")
    bits = max(0, (rows.count() // ROWS_A_RANGE).bit_length())
    span = F.shiftright("key", KEY_BITS - bits)  # ranges of keys, and ranges of those, so that no list of totals is long
    outer = lambda c: F.shiftright(c, bits // 2)
    rows = rows.withColumn("span", span)
    fine = stored(rows.groupBy("group", "span").agg(F.sum(F.col("size") * F.col("copies")).alias("words")), "mix-spans").withColumn("outer", outer("span"))
    coarse = fine.groupBy("group", "outer").agg(F.sum("words").alias("words"))
    sources = stored(coarse.groupBy("group").agg(F.sum("words").alias("source_size")), "mix-sources")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    wanted = targets(sources, weights, share, most).withColumn("epochs", epochs).withColumn("left", budget - F.col("epochs") * F.col("source_size"))

    def before(within, by) -> Column:
        return F.coalesce(F.sum("words").over(Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    coarse = coarse.join(wanted, "group").withColumn("base", before(["group"], "outer")).drop("words")
    fine = fine.join(coarse, ["group", "outer"]).withColumn("base", F.col("base") + before(["group", "outer"], "span")).drop("words", "outer")
    up_to = Window.partitionBy("group", "span").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("own", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(up_to), F.lit(0)))
    more = F.floor((F.col("left") - F.col("base") - F.col("own")) / F.col("copies")).cast("long")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), more))
    return own.join(fine, ["group", "span"]).select("id", "group", "size", "key", "tie", "copies", "source_size", "target", "epochs", cut.alias("cut"))


def mixture(docs: DataFrame, weights: Sequence[float] | DataFrame = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, size (words), source_size, target (of its source), taken (words of it in the mix), epochs, cut.

    A source's documents stand in the order of a hash of seed and id. Its target, rounded down, is met exactly: `epochs`
    copies of every document, then one more of each from the start of the order until the budget ends, within a
    document if need be (`cut` words of it). Null, empty and blank texts have no words and take none; a null source is
    a source, the last one; a null id is told apart by its text. Rows equal in id and text share what is left for them
    evenly, rounded down. Other columns are ignored; an empty table gives an empty result. Reruns agree.
    """
    found = _decided(docs, weights, share, most, seed, id_col, text_col, source_col)
    copies = found.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("copies")))) if found.filter("copies > 1").limit(1).count() else found
    return copies.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"), "epochs", "cut")


def mixed(docs: DataFrame, weights: Sequence[float] | DataFrame = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of docs, each as often as mixture() takes it, with `epoch` (1, 2, ...); the text of the row
    in which a source's budget ends is cut after its last word. Rows that the mix doesn't take are left out.

    In a source the last row taken is a place in the order of keys, so a row for each source says everything; texts never
    pass a shuffle where the sources are few.
    """
    found = _decided(docs, weights, share, most, seed, id_col, text_col, source_col)
    place = F.struct("key", "tie")
    stop = found.groupBy("group").agg(F.max("epochs").alias("__epochs"), F.min_by(F.struct(F.col("key").alias("key"), F.col("tie").alias("tie"), F.col("cut").alias("cut")), F.when((F.col("cut") < F.col("size")), place)).alias("__stop"))
    stop = stored(stop.withColumn("__stop", F.when(F.col("__stop.cut").isNotNull(), F.col("__stop"))), "mix-cuts")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), *_keyed(docs, seed, id_col, text_col, source_col))
    if stop.count() <= FEW_SOURCES:
        met = rows.join(F.broadcast(stop), "group")
    else:
        met = rows.withColumn("__salt", F.pmod("key", F.lit(SALTS))).join(stop.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["group", "__salt"])
    here, end = F.struct("key", "tie"), F.struct("__stop.key", "__stop.tie")
    cut = F.when(F.col("__stop").isNull() | (here < end), F.col("size")).when(here == end, F.col("__stop.cut")).otherwise(0)
    times = F.col("__epochs") + F.when((cut > 0) & (F.col("size") > 0), 1).otherwise(0)
    out = met.withColumn("__cut", cut).withColumn("__times", times).filter("__times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    text = F.col(f"__row.`{text_col}`")
    short = F.array_join(F.slice(F.split(text.cast("string"), _AFTER_WORD), F.lit(1), F.greatest(F.col("__cut"), F.lit(1)).cast("int")), "")
    kept = F.when((F.col("epoch") > F.col("__epochs")) & (F.col("__cut") < F.col("size")), short).otherwise(text)
    return out.select(*(kept.alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns), "epoch")
