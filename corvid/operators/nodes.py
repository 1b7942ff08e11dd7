"""JSON documents and JSON Schemas as rows, by Spark's VARIANT type: one row for each node, found level by level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.schemas import ANNOTATIONS, PARTIAL, REF
from corvid.operators.fixpoint import fixpoint, spread


def _object(v: Column, path: str = "$") -> Column:
    """The members of an object as a map, null for anything else."""
    return F.try_variant_get(v, path, "map<string,variant>")


def _list(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def json_leaves(documents: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    """(on, path, leaf): each scalar, null and empty container of a JSON text column by its path (/a/0/b), as JSON text.

    A level of containers is one projection, so a document costs as many rounds as it is deep, and documents of one depth go
    together. Null and invalid texts have no rows. Keys are taken as they are, so a key with a slash looks like two."""
    on = list(on)
    seed = documents.select(*on, F.lit("").alias("path"), F.try_parse_json(value).alias("node")).filter("node IS NOT NULL")

    def parts(v: Column) -> Column:
        of_object = F.transform(F.map_entries(_object(v)), lambda e: F.struct(F.concat(F.lit("/"), e["key"]).alias("step"), e["value"].alias("node")))
        of_list = F.transform(_list(v), lambda x, k: F.struct(F.concat(F.lit("/"), k.cast("string")).alias("step"), x.alias("node")))
        return F.coalesce(of_object, of_list)

    def step(last: DataFrame) -> DataFrame:
        return last.select(*on, "path", F.explode(parts(F.col("node"))).alias("p")).select(*on, F.concat("path", "p.step").alias("path"), F.col("p.node").alias("node"))

    found = fixpoint(seed, step, None, "leaves")
    inner = F.coalesce(F.size(parts(F.col("node"))), F.lit(0)) > 0
    return found.filter(~inner).select(*on, "path", F.to_json("node").alias("leaf"))


def equal_documents(left: DataFrame, right: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    """(on, equal): whether two tables hold the same JSON for a key, without regard to the order of members. A key that only
    one of them has is unequal. Compared by leaves, so a difference costs no more than the documents' size."""
    a = json_leaves(left, on, value).select(*on, "path", F.col("leaf").alias("a"))
    b = json_leaves(right, on, value).select(*on, "path", F.col("leaf").alias("b"))
    same = a.join(b, [*on, "path"], "full").groupBy(*on).agg(F.every(F.col("a").eqNullSafe(F.col("b"))).alias("equal"))
    keys = left.select(*on).unionByName(right.select(*on)).distinct()
    return keys.join(same, list(on), "left").select(*on, F.coalesce("equal", F.lit(False)).alias("equal"))


def _said(v: Column, key: str) -> Column:
    """A keyword's value where it is an object that says something."""
    found = F.try_variant_get(v, f"$['{key}']", "variant")
    return F.when(F.size(_object(found)) > 0, F.array(found))


def _subschemas(v: Column) -> Column:
    """The schemas of a node that decide about its shape: those of values that must be there, others where they say anything."""
    none = F.array().cast("array<variant>")
    items = F.try_variant_get(v, "$.items", "variant")
    lists = [_list(v, f"$.{k}") for k in ("anyOf", "oneOf", "allOf", "prefixItems", "items")]
    maps = [F.map_values(_object(v, "$.properties"))] + [F.filter(F.map_values(_object(v, f"$.{k}")), lambda x: F.size(_object(x)) > 0) for k in ("patternProperties", "dependentSchemas")]
    single = [F.when(_object(items).isNotNull(), F.array(items))] + [_said(v, k) for k in ("contains", "propertyNames", "not", "if", "then", "else", "additionalProperties", "unevaluatedProperties")]
    return F.filter(F.concat(*(F.coalesce(x, none) for x in (*lists, *maps, *single))), lambda x: _object(x).isNotNull())


def _open(v: Column) -> Column:
    """Whether a node by itself leaves its shape open."""
    own = _object(v)
    keys = F.map_keys(own)
    silent = F.forall(keys, lambda k: k.isin(*sorted(ANNOTATIONS)) | k.startswith("x-"))
    mark = F.try_variant_get(v, f"$['{PARTIAL}']", "variant")
    partial = F.coalesce(F.size(_list(mark)) > 0, F.size(_object(mark)) > 0, F.try_variant_get(mark, "$", "boolean"), mark.isNotNull() & ~F.is_variant_null(mark) & (F.to_json(mark) != '""'))
    kinds = F.coalesce(F.try_variant_get(v, "$.type", "array<string>"), F.array(F.try_variant_get(v, "$.type", "string")))
    most = F.try_variant_get(v, "$.maxItems", "variant")
    bound = F.when(~F.to_json(most).isin("true", "false") & ~F.to_json(most).startswith('"'), F.try_variant_get(most, "$", "double"))
    prefix = F.coalesce(F.size(_list(v, "$.prefixItems")), F.lit(0))
    told = F.array_contains(keys, "items") | F.coalesce(bound == 0, F.lit(False)) | _list(v, "$.anyOf").isNotNull() | _list(v, "$.oneOf").isNotNull() | _list(v, "$.allOf").isNotNull()
    array = F.coalesce(F.array_contains(kinds, "array"), F.lit(False)) & ~told & ((prefix == 0) | bound.isNull() | (bound > prefix))
    return F.coalesce(partial, F.lit(False)) | silent | array


def schema_nodes(schemas: DataFrame, on: Sequence[str] = (), schema: str = "schema") -> DataFrame:
    """(on, name, round, open, to): each node of a schema that decides about its shape, how deep it lies, whether it leaves its
    shape open, and the component that it refers to.

    schemas: on, name and a schema as JSON text. A null or invalid schema is one open node."""
    on = list(on)
    v = F.col("node")
    seed = schemas.select(*on, "name", F.coalesce(F.try_parse_json(schema), F.parse_json(F.lit("{}"))).alias("node"))
    seed = seed.select(*on, "name", F.when(F.is_variant_null(v), F.parse_json(F.lit("{}"))).otherwise(v).alias("node")).filter(_object(v).isNotNull())
    found = fixpoint(seed, lambda last: last.select(*on, "name", F.explode(_subschemas(v)).alias("node")), None, "nodes")
    ref = F.try_variant_get(v, "$['$ref']", "string")
    to = F.when(ref.startswith(REF), F.replace(F.replace(F.substring(ref, F.lit(len(REF) + 1), F.lit(1 << 20)), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    return found.select(*on, "name", "round", _open(v).alias("open"), to.alias("to"))


def unknown_schemas(schemas: DataFrame, on: Sequence[str] = (), schema: str = "schema") -> DataFrame:
    """(on, name, unknown): whether any part of a schema's shape isn't known, in it or in what it refers to.

    A schema is unknown where one of its nodes is open or refers to a name that no schema of the same `on` has, and where one
    that it refers to is; references are followed by a fixpoint over the table of them, so cycles leave nothing unknown
    by themselves. Names are unique within `on`."""
    on = list(on)
    known = F.struct(*on, "name")
    nodes = schema_nodes(schemas, on, schema)
    links = nodes.filter("to IS NOT NULL").select(*on, "name", "to").distinct()
    missing = links.join(schemas.select(*on, F.col("name").alias("to")).hint("merge"), [*on, "to"], "left_anti").select(known.alias("node"))
    seeds = nodes.filter("open").select(known.alias("node")).unionByName(missing).distinct().withColumn("label", F.lit("unknown"))
    edges = links.select(known.alias("node"), F.struct(*on, F.col("to").alias("name")).alias("base"))
    reached = spread(seeds, edges).select("node.*", F.lit(True).alias("unknown"))
    return schemas.select(*on, "name").join(reached.hint("merge"), [*on, "name"], "left").select(*on, "name", F.coalesce("unknown", F.lit(False)).alias("unknown"))
