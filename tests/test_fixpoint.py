import random
from collections import defaultdict

import pytest

from corvid.operators import closure, fixpoint


def edges(spark, pairs):
    return spark.createDataFrame(list(pairs), "node string, base string")


def brute_distance(pairs, starts):
    up = defaultdict(set)
    for a, b in pairs:
        if a is not None and b is not None:
            up[a].add(b)
    out = {}
    for s in starts:
        level, n = {s}, 0
        while level:
            for x in level:
                out.setdefault((s, x), n)
            level, n = {y for x in level for y in up[x] if (s, y) not in out}, n + 1
    return out


def test_classes_over_random_graphs_with_cycles(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "MERGED", 2)  # merge again and again
    rng = random.Random(1)
    names = [f"c{k}" for k in range(40)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(45)] + [("c0", "c0"), (None, "c1"), ("c1", None)] + [(f"d{k}", f"d{k - 1}") for k in range(1, 9)]
    kinds = {"c3": "model", "c7": "enum", "c9": "model", "d0": "enum", "d4": "model"}
    distance = brute_distance(pairs, {x for p in pairs for x in p if x})
    got = {(r.node, r.ancestor): r.distance for r in fixpoint.ancestors(edges(spark, pairs)).collect()}
    assert got == distance
    want = {}
    for (a, b), d in sorted(distance.items(), key=lambda x: x[1]):
        if b in kinds and (a not in want or (d, kinds[b] != "enum") < want[a]):
            want[a] = (d, kinds[b] != "enum")
    classes = spark.createDataFrame([(n, kinds.get(n)) for n in {x for p in pairs for x in p if x}], "node string, kind string")
    found = {r.node: r.kind for r in fixpoint.classified(classes, edges(spark, pairs), ["enum", "model"]).collect()}
    assert found == {n: "model" if x[1] else "enum" for n, x in want.items()}
    assert fixpoint.classified(classes.limit(0), edges(spark, pairs), ["enum"]).count() == 0
    assert fixpoint.ancestors(edges(spark, pairs).limit(0)).count() == 0


def test_members_come_from_the_nearest_ancestor(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")]
    members = spark.createDataFrame([("d", "x", "1"), ("c", "x", "2"), ("b", "x", "3"), ("d", "y", "4"), ("a", "z", "5")], "node string, name string, value string")
    got = {(r.node, r.name): (r.value, r.owner, r.distance) for r in fixpoint.inherited(members, edges(spark, pairs)).collect()}
    assert got["a", "x"] == ("3", "b", 1) and got["a", "y"] == ("4", "d", 2) and got["d", "x"] == ("1", "d", 0) and got["c", "z"] == ("5", "a", 2) and got["b", "x"] == ("3", "b", 0)


def test_renaming_goes_through_references(spark):
    schemas = spark.createDataFrame([("A", True), ("B", False), ("C", False), ("A_2", True), ("input_A", False), ("input_B_2", False)], "name string, differs boolean")
    refs = spark.createDataFrame([("B", "A"), ("C", "input_A"), ("A", "B")], "name string, to string")
    got = {r.name: r.new_name for r in fixpoint.renamed(schemas, refs).collect()}
    assert got == {"A": "input_A_3", "B": "input_B", "A_2": "input_A_2"}


def test_a_round_joins_the_last_rounds_rows_alone(spark):
    joined = []

    def step(last):
        joined.append(last.count())
        return last.selectExpr("(node * 2) % 64 AS node").unionByName(last.selectExpr("(node + 7) % 64 AS node"))

    found = fixpoint.fixpoint(spark.createDataFrame([(1,)], "node long"), step, ["node"])
    assert sum(joined) == found.count() == 64


def test_deep_chains(spark):
    """200 levels of classes and 10 of exceptions with plans of the same size, with a way back."""
    deep = 200
    pairs = [(f"e{k}", f"e{k + 1}") for k in range(deep)] + [(f"e{deep}", "e5")]
    found = fixpoint.spread(spark.createDataFrame([(f"e{deep}", "model")], "node string, label string"), edges(spark, pairs))
    assert found.count() == deep + 1 and found.agg({"round": "max"}).first()[0] == deep
    handlers = spark.createDataFrame([("e10", "last")], "error string, handler string")
    parents = edges(spark, pairs).toDF("error", "parent")
    raised = spark.createDataFrame([(1, "e0"), (2, "e9"), (3, "other"), (4, None)], "route int, error string")
    assert sorted(map(tuple, closure.exception_handlers(raised, handlers, parents).collect())) == [(1, "e0", "last"), (2, "e9", "last")]


def test_mounts_of_any_depth_and_their_limits(spark):
    chain = spark.createDataFrame([(f"r{k}", f"r{k + 1}", "/p") for k in range(12)] + [("r12", "r3", "/q")], "parent string, child string, prefix string")
    roots = spark.createDataFrame([("r0", "")], "router string, prefix string")
    reached, cycles = closure.mount_closure(roots, chain)
    assert reached.count() == 13 and reached.agg({"depth": "max"}).first()[0] == 12
    assert [tuple(r) for r in cycles.collect()] == [("r12", "r3", "/p" * 12 + "/q")]
    with pytest.raises(ValueError, match="nested"):
        closure.mount_closure(roots, chain, depth=5)


def test_exceptions_take_the_nearest_class(spark):
    parents = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "x"), ("c", "y"), ("x", "a")], "error string, parent string")
    handlers = spark.createDataFrame([("x", "hx"), ("c", "hc"), ("x", "ha")], "error string, handler string")
    raised = spark.createDataFrame([(1, "a"), (2, "b"), (3, "y"), (3, "x")], "route int, error string")
    assert sorted(map(tuple, closure.exception_handlers(raised, handlers, parents).collect())) == [(1, "a", "hc"), (2, "b", "ha"), (3, "x", "ha")]


def test_members_go_down_once_for_each_name(spark, monkeypatch):
    """Of a chain of 30 classes that all define x, each is done after one round; pairs of ancestors would be 30 * 31 / 2."""
    pairs = [(f"c{k:02}", f"c{k + 1:02}") for k in range(30)] + [("c30", "c00"), ("other", "c05")]
    members = spark.createDataFrame([(f"c{k:02}", "x", str(k)) for k in range(31)] + [("c30", None, "n"), ("c29", "y", None)], "node string, name string, value string")
    seen, real = [], fixpoint.fixpoint
    monkeypatch.setattr(fixpoint, "fixpoint", lambda *a, **b: real(*a, **b, after=lambda n, rows: seen.append(rows)))
    got = {(r.node, r.name): (r.value, r.owner, r.distance) for r in fixpoint.inherited(members, edges(spark, pairs)).collect()}
    assert got["c07", "x"] == ("7", "c07", 0) and got["other", "x"] == ("5", "c05", 1) and got["c00", None] == ("n", "c30", 30) and got["other", "y"] == (None, "c29", 25)
    assert len(got) == 32 * 3 and sum(seen) == len(got)
    some = fixpoint.inherited(members, edges(spark, pairs), of=edges(spark, [("c28", "")]).select("node")).collect()
    assert sorted((r.node, r.name or "") for r in some) == [("c28", ""), ("c28", "x"), ("c28", "y")]


def test_rounds_broadcast_nothing(spark):
    pairs = edges(spark, [(f"n{k}", f"n{k + 1}") for k in range(5)])
    plans, real = [], fixpoint.written

    def written(df, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, path)

    fixpoint.written = written
    try:
        assert fixpoint.spread(spark.createDataFrame([("n5", "a")], "node string, label string"), pairs).count() == 6
    finally:
        fixpoint.written = real
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)
