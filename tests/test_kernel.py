import json
import random

import pytest
from pyspark.sql import functions as F

from corvid.functions import paths
from corvid.functions import schemas as S
from corvid.operators import closure, dedupe, diff, gate, merge, score, variants


def test_paths(spark):
    cases = [
        ("express", "/a/:id(\\d+)/:opt?/*", "/a/{id}/{opt}/{wildcard}"), ("express", "/f/*rest", "/f/{rest}"), ("hono", "/x/:y/*", "/x/{y}/{wildcard}"), ("fastapi", "/p/{f:path}", "/p/{f}"),
        ("flask", "/u/<uuid:u>/<n>", "/u/{u}/{n}"), ("django", "^a/(?P<pk>[0-9]+)/?$", "a/{pk}/"), ("gin", "/f/*all", "/f/{all}"), ("echo", "/f/*all", "/f/{wildcard}"), ("chi", "/c/{s:[a-z-]+}", "/c/{s}"),
        ("nethttp", "GET /n/{p...}", "/n/{p}"), ("axum", "a/:b/*c", "/a/{b}/{c}"), ("axum", "", "/"), ("actix", "/{a:\\d+}/{tail:.*}*", "/{a}/{tail}"), ("rocket", "/<id:usize>", "/{id}"), ("laravel", "users/{id?}/", "/users/{id}"),
        ("laravel", "/", "/"), ("symfony", "/{page<\\d+>?1}", "/{page<\\d+>}"), ("aspnet", "/{id:int?}/{*slug}", "/{id}/{slug}"), ("nextjs", "/(shop)/a/[id]/[[...o]]", "/a/{id}/{o}"), ("slim", "/i/{id:[0-9]{1,3}}/x", "/i/{id}/x"),
    ]
    for dialect, raw, want in cases:
        got = spark.createDataFrame([(raw,), (None,)], "raw string").select(paths.template_path(F.col("raw"), dialect).alias("p")).collect()
        assert [r.p for r in got] == [want, None], dialect
    df = spark.createDataFrame([("get", "/items/{item_id}/x-y/"), ("POST", "/"), ("put", "/a--/-b")], "m string, p string")
    got = df.select(paths.operation_id(F.col("m"), F.col("p")).alias("i"), paths.tag(F.col("p"), F.lit("src/users.ts")).alias("t")).collect()
    assert [tuple(r) for r in got] == [("getItemsItemIdXY", "items"), ("post", "users"), ("putA-B", "a--")]
    files = spark.createDataFrame([("src/app/(x)/users/[id]/route.ts",), ("pages/api/a/index.ts",)], "f string").select(paths.next_path(F.col("f")).alias("p")).collect()
    assert files[0].p.endswith("/users/{id}") and files[1].p == "/api/a"


def test_dedupe(spark):
    rows = [(k, n, (n * 7) % 5) for k in "ab" for n in range(20)]
    df = spark.createDataFrame(rows, "k string, n int, s int").repartition(3)
    best = {r.k: r.n for r in dedupe.keep_best(df, ["k"], F.col("s"), F.col("n")).collect()}
    assert best == {k: min(n for x, n, s in rows if x == k and s == 4) for k in "ab"}
    assert {r.k: r.n for r in dedupe.first_wins(df, ["k"], F.col("n")).collect()} == {"a": 0, "b": 0}
    assert dedupe.duplicates(df, ["k"], F.col("n")).count() == 38
    assert dedupe.free_names(["a", "a", "a_2", "a", "b"]) == ["a", "a_3", "a_2", "a_4", "b"]
    assert dedupe.free_names(["a", "a", "a_2"]) == ["a", "a_3", "a_2"]


def test_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, h string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, h string")
    assert {tuple(r) for r in diff.snapshot_diff(a, b, "k", "h").collect()} == {(1, "removed"), (2, "changed"), (4, "added")}
    assert diff.snapshot_diff(a, a, "k", "h").count() == 0
    assert {r.k for r in diff.affected(diff.snapshot_diff(a, b, "k", "h"), "k").collect()} == {2, 4}
    assert [r.k for r in diff.left_over(a, b, "k").collect()] == [1]


def test_closure(spark):
    roots = spark.createDataFrame([("app", "")], "router string, prefix string")
    edges = spark.createDataFrame([("app", "a", "/a"), ("a", "b", "/b"), ("app", "b", "/c"), ("b", "a", "/back")], "parent string, child string, prefix string")
    reached, cycles = closure.mount_closure(roots, edges)
    assert {(r.router, r.prefix) for r in reached.collect()} == {("app", ""), ("a", "/a"), ("b", "/a/b"), ("b", "/c"), ("a", "/c/back")}
    assert {(r.parent, r.prefix) for r in cycles.collect()} == {("b", "/a/b/back"), ("a", "/c/back/b")}
    with pytest.raises(ValueError, match="budget"):
        closure.mount_closure(roots, edges, budget=2)


def test_schemas():
    known = {"A": {"type": "object", "properties": {"b": {"$ref": S.REF + "A"}}}, "x/y": {"type": "string"}}
    assert S.has_unknown(None) and S.has_unknown({}) and S.has_unknown({"title": "t", "x-a": 1}) and S.has_unknown({"type": "array"}) and S.has_unknown({"$ref": S.REF + "Nope"}, known)
    assert S.has_unknown({"type": "object", "properties": {"a": {}}}) and S.has_unknown({"anyOf": [{"type": "string"}, {}]}) and S.has_unknown({"type": "string", S.PARTIAL: ["why"]})
    for fine in ({"type": "string"}, {"$ref": S.REF + "A"}, {"$ref": S.REF + "x~1y"}, {"type": "array", "maxItems": 0}, {"type": "array", "prefixItems": [{"type": "string"}], "maxItems": 1}, {"type": "object", "additionalProperties": {}}, {"type": "string", S.PARTIAL: []}):
        assert not S.has_unknown(fine, known), fine
    assert S.without_hazards({"properties": {"constructor": 1, "a": 2}, "required": ["a", "__proto__"]}) == {"properties": {"a": 2}, "required": ["a"]}
    components: dict = {}
    out = S.hoisted({"$defs": {"P": {"$ref": "#/$defs/Q"}, "Q": {"type": "string"}}, "items": {"$ref": "#/$defs/P"}}, components)
    assert out == {"items": {"$ref": S.REF + "P"}} and components == {"P": {"$ref": S.REF + "Q"}, "Q": {"type": "string"}}
    assert S.namespaced({"A": {"$ref": S.REF + "A"}}, "p_") == {"p_A": {"$ref": S.REF + "p_A"}}
    assert S.filled({"type": "object", "properties": {"a": {}, "b": {"type": "string"}}}, {"properties": {"a": {"type": "integer"}, "b": {"type": "number"}}})["properties"] == {"a": {"type": "integer"}, "b": {"type": "string"}}
    assert S.filled({"type": "string"}, {"type": "integer", "minimum": 0}) == {"type": "string"}
    assert S.filled({"type": "object", "properties": {"a": {"type": "string"}}}, {"properties": {"a": {}, "x": {"type": "null"}}}) == {"type": "object", "properties": {"a": {"type": "string"}}}
    assert S.filled({"anyOf": [{"type": "array"}]}, {"type": "array", "items": {"type": "string"}}) == {"type": "array", "items": {"type": "string"}} and S.filled({"anyOf": [{"type": "array"}]}, {"type": "array"}) == {"anyOf": [{"type": "array"}]}
    assert S.clamped({"type": "weird", "properties": {"a": {"type": "string", "evil": 1}, "constructor": {}}, "x": 1}) == {"properties": {"a": {"type": "string"}}}
    a, b = {"x": 1, "y": {"z": 2, "w": 3}}, {"y": {"w": 3, "z": 2}, "x": 1}
    assert S.canonical(a) == S.canonical(b) and S.ordered(a) != S.ordered(b)
    assert S.fingerprint("h", {**a, "origin": 1}, {}) == S.fingerprint("h", {**b, "confidence": "low"}, {}) != S.fingerprint("i", a, {})
    assert S.leaves({"a": [1, {"b": 2}], "c": {}}) == {"/a/0": 1, "/a/1/b": 2, "/c": {}}


def test_gate_is_exact_and_idempotent():
    base = {"full_path": "/a/{id}/{x}", "parameters": [{"name": "x", "in": "path", "required": True, "schema": None, "confidence": "high"}], "confidence": "high", "gaps": ["auth-unknown"]}
    out = gate.gated({**base, "responses": [{"status_code": "200", "content": [{"media_type": "application/json", "schema": {"type": "string"}}]}]})
    assert out["confidence"] == "high" and out["gaps"] == ["auth-unknown"]
    assert [(p["name"], p["confidence"]) for p in out["parameters"]] == [("x", "medium"), ("id", "low")]
    assert gate.gated(out) == out
    grades = {
        (): ("low", ["response-unknown"]), ("204",): ("high", []), ("200",): ("high", []),
    }
    for statuses, (confidence, gaps) in grades.items():
        got = gate.gated({"full_path": "/", "confidence": "high", "responses": [{"status_code": s} for s in statuses]})
        assert (got["confidence"], got["gaps"]) == (confidence, gaps)
    media = lambda m, s=None: gate.gated({"full_path": "/", "confidence": "high", "responses": [{"status_code": "200", "content": [{"media_type": m, "schema": s}]}]})
    assert media("application/json")["gaps"] == ["response-schema-unknown"] and media("application/json", {})["gaps"] == ["response-schema-unknown"]
    assert media("text/event-stream; x")["gaps"] == ["sse-events-unknown"] and media("text/html; charset=utf-8")["gaps"] == []
    assert gate.gated({"full_path": "/", "confidence": "high", "request_body": {"content": []}, "responses": [{"status_code": "204", "content": [{"media_type": "a/b"}]}]})["gaps"] == ["body-schema-unknown"]


def test_variants(spark):
    a, b, c = {"type": "string"}, {"type": "integer"}, {"anyOf": [{"type": "string"}, {"type": "null"}]}
    assert variants.union_schema(a, a) == a and variants.union_schema(a, b) == {"anyOf": [a, b]} and variants.union_schema(c, a) == c
    got = variants.union_by_status([{"status_code": "200", "confidence": "high", "content": [{"media_type": "j", "schema": a}]}, {"status_code": "200", "confidence": "low", "content": [{"media_type": "j", "schema": b}, {"media_type": "k", "schema": a}]}])
    assert got == [{"status_code": "200", "confidence": "low", "content": [{"media_type": "j", "schema": {"anyOf": [a, b]}}, {"media_type": "k", "schema": a}]}]
    df = spark.createDataFrame([("k", json.dumps(s), n) for n, s in enumerate([b, a, b, c])], "k string, s string, n int")
    assert json.loads(variants.union_schemas(df, ["k"], "s", "n").first().s) == {"anyOf": [b, a, {"type": "null"}]}


def test_merge():
    user = {"paths": {"/a": {"get": {"summary": "mine", "x-own": 1, "parameters": [{"name": "q", "in": "query", "description": "mine"}, {"name": "z", "in": "query"}], "responses": {"200": {"description": "mine"}, "418": {}}}, "post": {"summary": "kept"}}}, "components": {"schemas": {"A": {"type": "string"}}}}
    scan = {"paths": {"/a": {"get": {"summary": "new", "parameters": [{"name": "q", "in": "query", "required": True}], "responses": {"200": {"description": "", "content": {"j": {"schema": {"$ref": S.REF + "A"}}}}}}}, "/b": {"get": {}}}, "components": {"schemas": {"A": {"type": "integer"}, "B": {"$ref": S.REF + "A"}}}}
    before = json.dumps([user, scan])
    out, report = merge.merge_document(user, scan, [("changed", "get", "/a"), ("added", "get", "/b"), ("removed", "post", "/a"), ("added", "get", "/none")])
    got = out["paths"]["/a"]["get"]
    assert got["summary"] == "mine" and got["x-own"] == 1 and [p["name"] for p in got["parameters"]] == ["q", "z"] and got["parameters"][0] == {"name": "q", "in": "query", "required": True, "description": "mine"}
    assert got["responses"]["200"]["description"] == "mine" and got["responses"]["200"]["content"]["j"]["schema"]["$ref"].endswith("/A2") and "418" in got["responses"]
    assert out["components"]["schemas"] == {"A": {"type": "string"}, "A2": {"type": "integer"}, "B": {"$ref": S.REF + "A2"}}
    assert report == {"added": ["get /b"], "changed": ["get /a"], "removed": ["post /a"], "renamed": {"A": "A2"}} and "post" in out["paths"]["/a"]
    assert json.dumps([user, scan]) == before


def test_scorecard(spark):
    found = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    wanted = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d"), (5, "e")], "k int, v string")
    r = score.scorecard(found, wanted, ["k"], "v").first()
    assert (r.recall, r.precision, r.accuracy, r.overall, r.accepted) == (0.5, 0.6667, 0.5, 0.5, False)
    rng = random.Random(1)
    df = spark.createDataFrame([(k, n, rng.randrange(1, 9)) for k in "ab" for n in range(30)], "k string, n int, size int")
    kept = score.budgeted(df, ["k"], F.col("size"), [F.col("n")], 8, 24).collect()
    for k in "ab":
        own = [r for r in kept if r.k == k]
        assert len(own) <= 8 and sum(r.size for r in own) <= 24 and sorted(r.n for r in own) == list(range(len(own)))


def test_unique_names_of_hot_groups(spark):
    import random
    import time

    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["r", "r", "r", "q", "r_2", "q_3", "r_2_2", "r_02", "r_1", *(f"r_{n}" for n in (3, 5, 6, 9, 40, 10**30))]), k) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, name string, o long").repartition(3)
    want = {}
    for g in ("a", "b", None):
        own = [r for r in rows if r[0] == g]
        want |= dict(zip((r[2] for r in own), dedupe.free_names([r[1] for r in own])))
    for rows_a_block in (50_000, 7):
        got = dedupe.unique_names(df, "g", "name", "o", "new", rows_a_block)
        assert got.columns == ["g", "name", "o", "new"]
        assert sorted((r.o, r.new) for r in got.collect()) == sorted(want.items())
    assert dedupe.unique_names(df.limit(0), "g", "name", "o", "new").count() == 0
    start = time.monotonic()
    names = dedupe.free_names(["r"] * 40_000)
    assert names[-1] == "r_40000" and time.monotonic() - start < 5
