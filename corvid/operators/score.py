"""Reports over candidates: counts, gap histograms and accuracy against an independent baseline."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the share that every axis of a scorecard has to reach.
ACCEPTED = 0.95


def scan_report(candidates: DataFrame, confidence: str = "confidence", gaps: str = "gaps") -> DataFrame:
    """One row: routes, those of high confidence and not, those with gaps, and gaps in all."""
    return candidates.agg(
        F.count(F.lit(1)).alias("routes"),
        F.count_if(F.col(confidence) == "high").alias("high"),
        F.count_if(F.col(confidence) != "high").alias("not_high"),
        F.count_if(F.size(gaps) > 0).alias("with_gaps"),
        F.coalesce(F.sum(F.size(gaps)), F.lit(0)).cast("long").alias("gaps"),
    )


def gap_histogram(candidates: DataFrame, gaps: str = "gaps") -> DataFrame:
    return candidates.select(F.explode(gaps).alias("gap")).groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to four places; nothing to find counts as found."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(F.round(part / whole, 4))


def scorecard(found: DataFrame, wanted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: recall, precision and accuracy of values on keys of both; overall is the least that isn't zero.

    `wanted` must not come from the scanner."""
    a = found.select(*keys, F.col(value).alias("__a"), F.lit(1).alias("__f"))
    b = wanted.select(*keys, F.col(value).alias("__b"), F.lit(1).alias("__w"))
    both = a.join(b, keys, "full_outer")
    hit = F.col("__f").isNotNull() & F.col("__w").isNotNull()
    counts = both.agg(F.count("__f").alias("f"), F.count("__w").alias("w"), F.count_if(hit).alias("h"), F.count_if(hit & F.col("__a").eqNullSafe(F.col("__b"))).alias("e"))
    axes = counts.select(F.col("f").alias("found"), F.col("w").alias("wanted"), F.col("h").alias("matched"), ratio(F.col("h"), F.col("w")).alias("recall"), ratio(F.col("h"), F.col("f")).alias("precision"), ratio(F.col("e"), F.col("h")).alias("accuracy"))
    positive = [F.when(F.col(c) > 0, F.col(c)) for c in ("recall", "precision", "accuracy")]
    return axes.withColumn("overall", F.coalesce(F.least(*positive), F.lit(0.0))).withColumn("accepted", F.col("overall") >= ACCEPTED)


#: What a baseline asserts about a route besides that it is there; of the last, what is unknown isn't counted apart.
FACETS = ("request", "response", "parameter", "constraint")


def audit(found: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how a scan does against an independent baseline on every axis, and whether it passes.

    Both tables: keys (of the route), facet ("route", with a null `at`, or one of FACETS), at (what it is about, such as a
    property's place) and value. An asserted value that the scan has counts as correct, one that it has as null, or not at all while it has
    the route, as unknown, any other as wrong; what a scan has beyond the baseline counts against precision for routes alone.

    recall, precision; request, response and parameter completeness (correct of asserted); constraint accuracy; unresolved (unknown of
    asserted, constraints apart). overall is the least axis above zero. accepted: routes reach ACCEPTED on both axes, every other
    axis does or asserts nothing, and no more than the rest is unresolved. Rows of both tables meet in one full join."""
    a = found.select(*keys, "facet", "at", F.col("value").alias("__a"), F.lit(True).alias("__f"))
    b = wanted.select(*keys, "facet", "at", F.col("value").alias("__b"), F.lit(True).alias("__w"))
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in (*keys, "facet", "at")]
    both = a.alias("x").join(b.alias("y"), reduce(and_, same), "full_outer")
    facet, hit, asserted = F.coalesce("x.facet", "y.facet"), F.col("__f") & F.col("__w"), F.col("__w")
    equal, known = F.col("__a") == F.col("__b"), F.col("__a").isNotNull()
    counts = [F.count_if((facet == "route") & asserted).alias("routes"), F.count_if((facet == "route") & hit).alias("matched"), F.count_if((facet == "route") & F.col("__f")).alias("scanned")]
    for x in FACETS:
        counts += [F.count_if((facet == x) & asserted).alias(f"{x}_total"), F.count_if((facet == x) & hit & equal).alias(f"{x}_correct"), F.count_if((facet == x) & asserted & ~F.coalesce(known, F.lit(False))).alias(f"{x}_unknown")]
    n = both.agg(*counts)
    part = lambda p, w: F.when(w == 0, F.lit(0.0)).otherwise(F.round(p / w, 4))
    three = [x for x in FACETS if x != "constraint"]
    total = lambda what: sum((F.col(f"{x}_{what}") for x in three[1:]), F.col(f"{three[0]}_{what}"))
    names = {"request": "request_completeness", "response": "response_completeness", "parameter": "parameter_completeness", "constraint": "constraint_accuracy"}
    axes = n.select(
        *n.columns, part(F.col("matched"), F.col("routes")).alias("recall"), part(F.col("matched"), F.col("scanned")).alias("precision"),
        *(part(F.col(f"{x}_correct"), F.col(f"{x}_total")).alias(names[x]) for x in FACETS), part(total("unknown"), total("total")).alias("unresolved"),
    )
    least = F.least(*(F.when(F.col(c) > 0, F.col(c)) for c in ("recall", "precision", *names.values())))
    passed = (F.col("recall") >= ACCEPTED) & (F.col("precision") >= ACCEPTED) & (F.col("unresolved") <= 1 - ACCEPTED)
    for x in FACETS:
        passed = passed & ((F.col(f"{x}_total") == 0) | (F.col(names[x]) >= ACCEPTED))
    return axes.select("routes", "matched", "scanned", "recall", "precision", *names.values(), "unresolved", F.coalesce(least, F.lit(0.0)).alias("overall"), passed.alias("accepted"))


def frameworks(candidates: DataFrame) -> DataFrame:
    """(project, frameworks): the frameworks of a project's routes, each once, in order of their names."""
    return candidates.groupBy("project").agg(F.sort_array(F.collect_set("framework")).alias("frameworks"))


def budgeted(df: DataFrame, group: list[str], size: Column, order: list[Column], most_rows: int, most_size: int) -> DataFrame:
    """Of each group the first rows in order while their number and total size stay within the budget."""
    from pyspark.sql.window import Window

    own = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn("__n", F.row_number().over(own)).withColumn("__size", F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.filter((F.col("__n") <= most_rows) & (F.col("__size") <= most_size)).drop("__n", "__size")
