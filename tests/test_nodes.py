import json
import random

from corvid.functions import schemas
from corvid.operators import nodes


def made(rng, depth=0):
    """A random schema with everything that counts for its shape."""
    r = rng.random()
    if r < 0.06:
        return {}
    if r < 0.1:
        return {"description": "x", "x-a": 1}
    if r < 0.2:
        return {"$ref": rng.choice(["#/components/schemas/S", "#/components/schemas/a~1b", "#/definitions/S"])[: rng.choice([80, 80, 23])] + str(rng.randrange(12))}
    out = {"type": rng.choice(["string", "integer", "object", "array", ["array", "null"], ["string"], 3])}
    deep = depth < 3
    if deep and rng.random() < 0.5:
        out["properties"] = {k: made(rng, depth + 1) for k in rng.sample("abcd", rng.randrange(3))}
    if rng.random() < 0.5:
        out["items"] = made(rng, depth + 1) if deep else rng.choice([{"type": "null"}, False, True, None])
    for k in ("anyOf", "oneOf", "allOf", "prefixItems", "items"):
        if deep and rng.random() < 0.08:
            out[k] = [made(rng, depth + 1) for _ in range(rng.randrange(3))]
    for k in ("contains", "not", "if", "then", "else", "propertyNames", "additionalProperties", "unevaluatedProperties"):
        if deep and rng.random() < 0.05:
            out[k] = rng.choice([{}, True, made(rng, depth + 1)])
    for k in ("patternProperties", "dependentSchemas"):
        if deep and rng.random() < 0.05:
            out[k] = {"^x": made(rng, depth + 1), "y": rng.choice([{}, True])}
    if rng.random() < 0.15:
        out["maxItems"] = rng.choice([0, 1, 2, 2.5, True, "3"])
    if rng.random() < 0.03:
        out["x-discovery-incomplete"] = rng.choice([[], ["why"], True, "", {}])
    return out


def test_unknown_schemas_equal_the_function(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for p in range(150):
        components = {f"S{k}": made(rng) for k in range(10)} | {f"a/b{k}": made(rng) for k in range(10)} | {"none": None}
        for name, s in components.items():
            rows.append((p, name, None if s is None else json.dumps(s)))
            want[p, name] = schemas.has_unknown(s, components)
    table = spark.createDataFrame(rows, "project int, name string, schema string").repartition(4)
    got = {(r.project, r.name): r.unknown for r in nodes.unknown_schemas(table, ["project"]).collect()}
    assert [(k, dict(r[1:] for r in [(0, k, v)])) for k, v in got.items() if v != want[k]] == [] and len(got) == len(want)
    assert 0.2 < sum(want.values()) / len(want) < 0.95
    assert nodes.unknown_schemas(table.limit(0), ["project"]).count() == 0


def test_leaves_equal_the_function(spark):
    values = ['{"a": [1, {"b": null, "c": []}], "d": {"e": "x", "f": {}}}', "3", "null", "[]", '{"k": [[true]]}', None, "{broken"]
    table = spark.createDataFrame(list(enumerate(values)), "id int, value string")
    got = {(r.id, r.path): json.loads(r.leaf) for r in nodes.json_leaves(table, ["id"]).collect()}
    assert got == {(k, p): x for k, v in enumerate(values[:5]) for p, x in schemas.leaves(json.loads(v)).items()}


def test_documents_are_equal_without_regard_to_order(spark):
    left = spark.createDataFrame([(1, '{"a": 1, "b": [1, 2]}'), (2, '{"a": 1}'), (3, "[1, 2]"), (4, "{}"), (6, None)], "id int, value string")
    right = spark.createDataFrame([(1, '{"b": [1, 2], "a": 1}'), (2, '{"a": 1, "b": 2}'), (3, "[2, 1]"), (4, "{}"), (5, "1")], "id int, value string")
    assert {r.id: r.equal for r in nodes.equal_documents(left, right, ["id"]).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}
