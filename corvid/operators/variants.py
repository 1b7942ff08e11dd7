"""Unions of response variants: same status and media type, different shapes."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.functions.schemas import ordered


def _alternatives(schema) -> list:
    schema = {} if schema is None else schema
    return schema["anyOf"] if list(schema) == ["anyOf"] and isinstance(schema["anyOf"], list) else [schema]


def union_schema(first, second):
    """One schema if both are equal in the order of their keys, else anyOf of all distinct alternatives."""
    if ordered(first) == ordered(second):
        return first
    out = list(_alternatives(first))
    out += [s for s in _alternatives(second) if ordered(s) not in {ordered(x) for x in out}]
    return {"anyOf": out}


def union_response(first: dict, second: dict) -> dict:
    """Two responses of a status as one: media types side by side, shapes of a media type as a union.

    Confidence is theirs if they agree, else low."""
    content = [dict(c) for c in first.get("content") or []]
    for item in second.get("content") or []:
        same = next((c for c in content if c["media_type"] == item["media_type"]), None)
        if same is None:
            content.append(dict(item))
            continue
        for k in ("schema", "item_schema"):
            if k in same or k in item:
                same[k] = union_schema(same.get(k), item.get(k))
    agreed = first.get("confidence") == second.get("confidence")
    return {**first, **({"content": content} if content else {}), "confidence": first.get("confidence") if agreed else "low"}


def union_by_status(responses: Iterable[dict]) -> list[dict]:
    out: dict = {}
    for r in responses:
        status = r["status_code"]
        out[status] = union_response(out[status], r) if status in out else r
    return list(out.values())


def event_schema(events: Iterable[dict]) -> dict:
    """What an event stream's items are, from its events ({name, data}): the data's shape, or the shapes as oneOf where
    they differ; if every event has a name, an envelope of the name, one of those, and the data."""
    events = list(events)
    shapes, names = [e["data"] for e in events if e.get("data")], [e["name"] for e in events if e.get("name")]
    if not shapes:
        return {}
    data = shapes[0] if len({ordered(s) for s in shapes}) == 1 else {"oneOf": shapes}
    if len(names) < len(events):
        return data
    return {"type": "object", "properties": {"event": {"type": "string", "enum": sorted(set(names))}, "data": data}, "required": ["event", "data"]}


def collected_responses(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Per key, status and media type one response: columns status, media_type, schema, replaces (boolean) and confidence,
    a row for each time that a handler's code answers.

    The first schema holds, unless a later row replaces it: then the last that does. Confidence is high if any row's is,
    else that of the first. An aggregation, combined before the shuffle."""
    found = F.col("schema").isNotNull()
    place = F.when(F.col("replaces"), -F.col(ordinal)).otherwise(F.col(ordinal))
    at = F.struct((~F.col("replaces")).alias("kept"), place.alias("place"))
    first = F.min_by("confidence", ordinal)
    return df.groupBy(*keys, "status", "media_type").agg(
        F.min_by(F.when(found, F.col("schema")), F.when(found, at)).alias("schema"),
        F.when(F.max(F.col("confidence") == "high"), "high").otherwise(first).alias("confidence"),
    )


def union_schemas(df: DataFrame, keys: list[str], schema: str, ordinal: str) -> DataFrame:
    """Per key the union of a JSON schema column in the order of ordinal.

    Distinct schemas are found by an aggregation with the first place of each, so that only alternatives, not rows,
    meet in a group: their number is that of shapes in source code."""
    from corvid.functions.schemas import on_json

    first = df.groupBy(*keys, schema).agg(F.min(ordinal).alias("__at"))
    listed = first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", schema))), lambda s: s[schema]).alias("__all"))

    def union(schemas):
        out = json.loads(schemas[0])
        for s in schemas[1:]:
            out = union_schema(out, json.loads(s))
        return out

    return listed.select(*keys, on_json(union)(F.to_json("__all")).alias(schema))


def table_rows(writes: DataFrame, table: str = "table") -> DataFrame:
    """(table, schema): the object that a row of a schema-less table is, as far as all writes to it prove it.

    writes: table, column, type (a schema as JSON text, null where it isn't known) and whole (the written row came whole from
    somewhere else, so it may hold more; its column is null). A column has a type if every write to it proves the same one, else it is
    open; a table with a whole row, or without any known column, has further properties."""
    columns = writes.filter("column IS NOT NULL").groupBy(table, "column").agg(F.when((F.min("type") == F.max("type")) & (F.count("type") == F.count(F.lit(1))), F.min("type")).alias("type"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("column", F.coalesce("type", F.lit("{}")).alias("type")))), lambda c: F.concat(F.regexp_extract(F.to_json(F.struct(c["column"].alias("c"))), r'^\{"c":(.*)\}$', 1), F.lit(":"), c["type"]))
    properties = columns.groupBy(table).agg(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("properties"))
    opened = writes.groupBy(table).agg(F.coalesce(F.bool_or("whole"), F.lit(False)).alias("open"))
    more = F.when(F.col("open") | F.col("properties").isNull(), ',"additionalProperties":{}').otherwise("")
    schema = F.concat(F.lit('{"type":"object"'), F.coalesce(F.concat(F.lit(',"properties":'), "properties"), F.lit("")), more, F.lit("}"))
    return opened.join(properties, table, "left").select(table, schema.alias("schema"))


def agreed_types(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Per key the type if every row has the same known one, else null: what a table without a schema holds."""
    return df.groupBy(*keys).agg(F.when((F.min(kind) == F.max(kind)) & (F.count(kind) == F.count(F.lit(1))), F.min(kind)).alias(kind))
