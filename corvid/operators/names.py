"""Names and import paths resolved to what declares them, as equality joins on exploded keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a use may find its symbol, the best first.
WRITTEN, IMPORTED, OWN, WILDCARD, SHORT = range(5)


def _quoted(separator: str) -> str:
    return "".join("\\" + c for c in separator)


def resolved_names(uses: DataFrame, symbols: DataFrame, separator: str = ".", on: Sequence[str] = (), short: bool = True) -> DataFrame:
    """(on, use, symbol, declared_in, by) of every use; the last three are null where nothing or no single thing is meant.

    uses: on, use (an id, unique), name, scope (its package or namespace), imports (map of local names to full names) and
    wildcards (array of packages); symbols: on, symbol (full name) and declared_in. A name means, in this order: the symbol
    that is written out (a name with a separator); what its first part is imported as; the symbol of its own scope; one of a
    wildcard's scope; and, with `short`, the only symbol whose last part it is. The best way that finds anything decides: if
    it finds several symbols, or one that is declared in several places, the name is ambiguous and stays null, whatever later
    ways find. A null name, scope, map or array finds nothing by its way.

    The ways become keys with a priority in one exploded column, met by one join with an index of one row for each key, and one
    aggregation settles a use.
    """
    on = list(on)
    sep, name = F.lit(separator), F.col("name")
    parts = F.split("name", _quoted(separator))
    dotted, first = F.size(parts) > 1, F.get(parts, F.lit(0))
    tail = lambda n: F.substring(name, n, F.lit(1 << 30))
    bare = F.when(name.startswith(separator), tail(F.lit(len(separator) + 1))).otherwise(name)
    key = lambda way, x: F.struct(F.lit(way).alias("way"), x.alias("key"))
    full = lambda *x: F.concat(F.lit("="), *x)
    ways = [
        F.array(key(WRITTEN, F.when(dotted, full(bare)))),
        F.array(key(IMPORTED, full(F.try_element_at("imports", first), tail(F.length(first) + 1)))),
        F.array(key(OWN, F.when(F.col("scope") == "", full(name)).otherwise(full("scope", sep, name)))),
        F.transform(F.coalesce("wildcards", F.array().cast("array<string>")), lambda w: key(WILDCARD, full(w, sep, name))),
    ]
    if short:
        ways.append(F.array(key(SHORT, F.when(~dotted, F.concat(F.lit("~"), name)))))
    looked = uses.select(*on, "use", F.explode_outer(F.array_distinct(F.filter(F.concat(*ways), lambda k: k["key"].isNotNull()))).alias("k")).select(*on, "use", "k.way", "k.key")
    keys = F.array(full("symbol"), F.concat(F.lit("~"), F.element_at(F.split("symbol", _quoted(separator)), -1)))
    place = F.struct("symbol", "declared_in")
    index = symbols.filter("symbol IS NOT NULL").select(*on, "symbol", "declared_in", F.explode(keys).alias("key")).groupBy(*on, "key").agg(F.min(place).alias("least"), F.max(place).alias("most"))
    met = looked.join(index, [*on, "key"], "left")
    hit = F.col("least").isNotNull()
    found = met.groupBy(*on, "use").agg(F.min(F.when(hit, F.struct("way", "least"))).alias("low"), F.max(F.when(hit, F.struct((-F.col("way")).alias("way"), F.col("most")))).alias("high"))
    single, low = F.col("low.least") == F.col("high.most"), F.col("low.least")
    by = F.get(F.array(*map(F.lit, ("written", "imported", "own", "wildcard", "short"))), F.col("low.way"))
    return found.select(*on, "use", F.when(single, low["symbol"]).alias("symbol"), F.when(single, low["declared_in"]).alias("declared_in"), F.when(single, by).alias("by"))


def by_suffix(wanted: DataFrame, files: DataFrame, on: Sequence[str] = (), separator: str = "/", least: int | None = None, unique: bool = False) -> DataFrame:
    """(on, name, path): the file that a name means, by the end of its path: whole parts, from the last one on.

    wanted: on and name; files: on, path, module (the path that is matched, without extension) and ordinal. Of several files that
    end in a name the last by ordinal counts, or with `unique` none. With `least`, a name that no file ends in is tried without its
    first parts while at least so many are left: its longest end that is found counts.

    Every end of a path is a key of an index with one row for each; a name is looked up by its own ends. So what is joined is the number of
    parts, not of pairs."""
    on = list(on)
    cut = lambda parts, n: F.array_join(F.slice(parts, n, F.size(parts)), separator)
    parts = F.split("module", _quoted(separator))
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: cut(parts, n))
    row = F.struct("ordinal", "path")
    index = files.filter("module <> ''").select(*on, "path", "ordinal", F.explode(ends).alias("__end")).groupBy(*on, "__end").agg(F.max(row).alias("__file"), F.min(row).alias("__other"))
    if unique:
        index = index.filter(F.col("__file.path") == F.col("__other.path"))
    mine = F.split("name", _quoted(separator))
    tries = F.array(F.struct(F.lit(0).alias("n"), F.col("name").alias("end"))) if least is None else F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(mine) - least + 1)), lambda n: F.struct(n.alias("n"), cut(mine, n).alias("end")))
    looked = wanted.select(*on, "name").filter("name <> ''").distinct().select(*on, "name", F.explode(tries).alias("__try")).select(*on, "name", F.col("__try.n").alias("__n"), F.col("__try.end").alias("__end"))
    return looked.join(index, [*on, "__end"]).groupBy(*on, "name").agg(F.min_by("__file.path", "__n").alias("path"))
