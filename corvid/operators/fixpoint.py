"""Least fixpoints by semi-naive evaluation: a round joins only the rows that the round before was the first to find.

Each round's rows are written to the shared folder, so a round's plan has the same size at any depth, executor storage
holds nothing, and a lost executor costs one round. Rows that were found before are dropped by an anti-join, which is
what ends cycles; no depth is fixed in advance. Of the rounds' files so many are merged at a time that the number of
files stays small and a row is written again once for each power of that number.

A round's joins are sort-merge joins by hint: tables below Spark's broadcast threshold would pass the driver again in each round.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corvid.tables import deleted, dropped, fresh_path, stored, written

#: Rounds whose files are merged into one folder.
MERGED = 16


class _Found:
    """All rows so far, as folders by how often their rows were merged."""

    def __init__(self, seed: DataFrame, label: str):
        self.spark, self.schema = seed.sparkSession, seed.schema
        self.root, self.made, self.tiers = fresh_path(self.spark, label), 0, [[]]

    def _path(self) -> str:
        self.made += 1
        return f"{self.root}/{self.made}"

    def add(self, rows: DataFrame) -> tuple[DataFrame | None, int]:
        """The rows from their files, or None where there are none, and their number."""
        path, seen = self._path(), Observation()
        level = written(rows.observe(seen, F.count(F.lit(1)).alias("n")), path)
        size = seen.get.get("n") or 0
        if not size:
            deleted(self.spark, path)
            return None, 0
        self.tiers[0].append(path)
        return level, size

    def merge(self) -> None:
        """Called between rounds; the newest rows stay in their own folder, which the next round reads."""
        for n in range(len(self.tiers)):
            if len(self.tiers[n]) <= MERGED:
                return
            old, self.tiers[n] = self.tiers[n][:MERGED], self.tiers[n][MERGED:]
            path = self._path()
            written(self.read(old).coalesce(self.spark.sparkContext.defaultParallelism), path)
            for p in old:
                deleted(self.spark, p)
            if len(self.tiers) == n + 1:
                self.tiers.append([])
            self.tiers[n + 1].append(path)

    def read(self, paths: Sequence[str] | None = None) -> DataFrame:
        paths = [p for tier in self.tiers for p in tier] if paths is None else paths
        return self.spark.read.schema(self.schema).parquet(*paths)


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], key: Sequence[str] | None, label: str = "fixpoint", after: Callable[[int, int], None] | None = None) -> DataFrame:
    """The rows of seed and all that `step` makes of found rows, one of each key, with `round`, the first that found it.

    `step` takes the rows of the last round and gives candidates of the same columns, without `round`. Of several candidates of
    a key in one round the least row stays, so the result doesn't depend on their order. Without a key all candidates
    stay, and `step` has to come to an end by itself. `after(round, rows)` is told how many new rows a round has and may raise
    to end the work. An empty seed gives an empty result.
    """
    others = [c for c in seed.columns if key and c not in key]

    def one_of_key(df: DataFrame, n: int) -> DataFrame:
        if key is None:
            pass
        elif others:
            df = df.groupBy(*key).agg(F.min(F.struct(*others)).alias("__rest")).select(*key, *(F.col(f"__rest.`{c}`").alias(c) for c in others))
        else:
            df = df.dropDuplicates(list(key))
        return df.select(*seed.columns).withColumn("round", F.lit(n))

    first = one_of_key(seed, 0)
    found, n = _Found(first, label), 0
    last, size = found.add(first)
    if last is None:
        return first.limit(0)
    while last is not None:
        if after:
            after(n, size)
        n += 1
        fresh = one_of_key(step(last.drop("round")).select(*seed.columns), n)
        last, size = found.add(fresh if key is None else fresh.join(found.read().select(*key).hint("merge"), list(key), "left_anti"))
        found.merge()
    return found.read()


def spread(labels: DataFrame, edges: DataFrame, label: str = "label") -> DataFrame:
    """(node, label, round): every node that has a label or reaches a node that has it along edges (node, base).

    A class is what its bases are: with edges from classes to their bases and labels of known base names this classifies all
    classes; with edges from schemas to what they refer to and a label on those that changed, it gives all that have to be
    renamed. A node may get several labels. Null nodes and bases are ignored; cycles and loops end.
    """
    edges = stored(edges.select(F.col("node").alias("__node"), F.col("base").alias("node")).filter("__node IS NOT NULL AND node IS NOT NULL").distinct(), "edges")
    seed = labels.select("node", label).filter("node IS NOT NULL")

    def step(last: DataFrame) -> DataFrame:
        return last.join(edges.hint("merge"), "node").select(F.col("__node").alias("node"), label)

    found = fixpoint(seed, step, ["node", label], "spread")
    dropped(edges)
    return found


def classified(classes: DataFrame, edges: DataFrame, order: Sequence[str]) -> DataFrame:
    """(node, kind) of each class that is of a kind: its own or that of the nearest base that has one; of kinds that are
    equally near the first in `order`.

    classes: node and kind (null where its own declaration doesn't tell); edges: node, base."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    found = spread(classes.filter(F.col("kind").isin(*order)).select("node", "kind"), edges, "kind")
    best = found.groupBy("node").agg(F.min_by("kind", F.struct("round", rank)).alias("kind"))
    return classes.select("node").distinct().join(best, "node")


def ancestors(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(node, ancestor, distance): all that a node inherits from, itself at distance 0; the shortest way counts.

    `of` (node) limits the nodes that are asked about; without it, every node of the edges is."""
    pairs = stored(edges.select("node", "base").filter("node IS NOT NULL AND base IS NOT NULL").distinct(), "edges")
    asked = (pairs.select("node").unionByName(pairs.select(F.col("base").alias("node"))) if of is None else of.select("node").filter("node IS NOT NULL")).distinct()
    up = pairs.select(F.col("node").alias("ancestor"), F.col("base").alias("__up"))

    def step(last: DataFrame) -> DataFrame:
        return last.join(up.hint("merge"), "ancestor").select("node", F.col("__up").alias("ancestor"))

    found = fixpoint(asked.select("node", F.col("node").alias("ancestor")), step, ["node", "ancestor"], "ancestors").withColumnRenamed("round", "distance")
    dropped(pairs)
    return found


def inherited(members: DataFrame, edges: DataFrame, value: str = "value", of: DataFrame | None = None) -> DataFrame:
    """(node, name, value, owner, distance): each member a class has, its own or from its nearest ancestor that has one of
    the name; of equally near owners the least.

    members: node, name and value, one row for each node and name; of (node) limits the classes that are asked about.

    Members go down, not classes up: a round hands each class the names that its bases were the first to get in the round
    before. A class's nearest owner of a name is as near, less one, to the base through which it is reached, so a name
    that a class has goes no further twice, and the work is that of the result rather than of all pairs of ancestors."""
    pairs = stored(edges.select("node", "base").filter("node IS NOT NULL AND base IS NOT NULL").distinct(), "edges")
    if of is None:
        down = pairs.select(F.col("base").alias("node"), F.col("node").alias("__down"))
    else:
        of = of.select("node").filter("node IS NOT NULL").distinct()
        up = fixpoint(of, lambda last: last.join(pairs.hint("merge"), "node").select(F.col("base").alias("node")), ["node"], "asked").select("node")
        down = pairs.join(up.hint("merge"), "node", "left_semi").select(F.col("base").alias("node"), F.col("node").alias("__down"))
        members = members.join(up.hint("merge"), "node", "left_semi")
    owned = members.filter("node IS NOT NULL").groupBy("node", F.struct("name").alias("name")).agg(F.min(F.struct(F.col(value).alias("value"))).alias("own"))  # a null name is one name
    down = stored(down, "down")

    def step(last: DataFrame) -> DataFrame:
        return last.join(down.hint("merge"), "node").select(F.col("__down").alias("node"), "name", "owner")

    found = fixpoint(owned.select("node", "name", F.col("node").alias("owner")), step, ["node", "name"], "inherited").withColumnRenamed("round", "distance")
    dropped(pairs)
    dropped(down)
    if of is not None:
        found = found.join(of.hint("merge"), "node", "left_semi")
    met = found.join(owned.withColumnRenamed("node", "owner"), ["owner", "name"])
    return met.select("node", F.col("name.name").alias("name"), F.col("own.value").alias(value), "owner", "distance")


def renamed(schemas: DataFrame, references: DataFrame, prefix: Column | None = None) -> DataFrame:
    """(name, new_name) of schemas whose input form differs from their output form, by themselves or through what they
    refer to.

    schemas: name, differs (whether the two forms differ without regard to names); references: name, to. A new name is
    `prefix` and the name (input_), with the first number from _2 on that no schema has where that name is taken."""
    prefix = F.lit("input_") if prefix is None else prefix
    changed = spread(schemas.filter("differs").select(F.col("name").alias("node"), F.lit(True).alias("label")), references.select(F.col("name").alias("node"), F.col("to").alias("base")))
    own = schemas.select("name").join(changed.select(F.col("node").alias("name")).hint("merge"), "name", "left_semi").withColumn("__new", F.concat(prefix, "name"))
    # what a new name may not be: names of schemas, and the first choices of others; by the name before its number
    names = schemas.select(F.col("name").alias("__taken")).unionByName(own.select(F.col("__new").alias("__taken")))
    parts = names.select("__taken", F.explode(F.array_distinct(F.array(F.col("__taken"), F.regexp_extract("__taken", r"^(.*?)(?:_[0-9]+)?$", 1)))).alias("__new"))
    first_choices = own.select(F.col("__new").alias("__taken"), "__new").join(schemas.select(F.col("name").alias("__taken")).hint("merge"), "__taken", "left_anti")
    taken = parts.exceptAll(first_choices).groupBy("__new").agg(F.collect_set("__taken").alias("__all"))
    both = own.join(taken.hint("merge"), "__new", "left").withColumn("__all", F.coalesce("__all", F.array().cast("array<string>")))
    tries = F.concat(F.array("__new"), F.transform(F.sequence(F.lit(2), F.size("__all") + 2), lambda n: F.concat("__new", F.lit("_"), n.cast("string"))))
    return both.select("name", F.get(F.filter(tries, lambda t: ~F.array_contains("__all", t)), F.lit(0)).alias("new_name"))
