import random

import pytest

from corvid.operators import context, names


def test_names_by_the_best_way_that_finds_one(spark):
    symbols = spark.createDataFrame([("a.X", "1"), ("b.X", "2"), ("c.Y", "3"), ("c.Y", "4"), ("d.Z", "5"), ("Top", "6"), ("a.W", "7"), ("b.W", "8"), (None, "9")], "symbol string, declared_in string")
    uses = [
        (1, "X", "a", None, None), (2, "X", "q", {"X": "b.X"}, ["a"]), (3, "X", "q", None, ["a", "b"]), (4, "Y", "c", None, None), (5, "Z", "q", None, None), (6, "X", "q", None, None), (7, "b.X", "a", None, None),
        (8, "I.X", "q", {"I": "a"}, None), (9, "Top", "", None, None), (10, None, "a", None, None), (11, "W", "q", {"W": "nowhere.W"}, ["b"]), (12, ".a.X", None, None, None), (13, "Z", "c", {"Q": "a.X"}, ["c"]),
    ]
    table = spark.createDataFrame(uses, "use int, name string, scope string, imports map<string,string>, wildcards array<string>")
    got = {r.use: (r.symbol, r.declared_in, r.by) for r in names.resolved_names(table, symbols).collect()}
    none = (None, None, None)
    assert got == {
        1: ("a.X", "1", "own"), 2: ("b.X", "2", "imported"), 3: none, 4: none, 5: ("d.Z", "5", "short"), 6: none, 7: ("b.X", "2", "written"), 8: ("a.X", "1", "imported"), 9: ("Top", "6", "own"), 10: none,
        11: ("b.W", "8", "wildcard"), 12: ("a.X", "1", "written"), 13: ("d.Z", "5", "short"),
    }
    assert names.resolved_names(table, symbols, short=False).filter("use = 5").first().symbol is None
    php = spark.createDataFrame([(1, "\\A\\B", "C", None, None), (2, "B", "A", None, None)], "use int, name string, scope string, imports map<string,string>, wildcards array<string>")
    assert {r.symbol for r in names.resolved_names(php, spark.createDataFrame([("A\\B", "f")], "symbol string, declared_in string"), "\\").collect()} == {"A\\B"}
    assert names.resolved_names(table.limit(0), symbols).count() == 0 and names.resolved_names(table, symbols.limit(0)).filter("symbol IS NULL").count() == len(uses)


def test_files_by_the_end_of_their_path(spark):
    files = spark.createDataFrame([("p", "src/app/a.py", "src/app/a", 1), ("p", "lib/app/a.py", "lib/app/a", 2), ("p", "b.py", "b", 3), ("q", "app/a.py", "app/a", 4)], "project string, path string, module string, ordinal int")
    wanted = spark.createDataFrame([("p", "app/a"), ("p", "src/app/a"), ("p", "pp/a"), ("p", "x/y/b"), ("q", "a"), ("p", ""), ("p", None)], "project string, name string")
    got = {(r.project, r.name): r.path for r in names.by_suffix(wanted, files, ["project"]).collect()}
    assert got == {("p", "app/a"): "lib/app/a.py", ("p", "src/app/a"): "src/app/a.py", ("q", "a"): "app/a.py"}
    assert {r.name: r.path for r in names.by_suffix(wanted, files, ["project"], least=1).collect() if r.project == "p"} == {"app/a": "lib/app/a.py", "src/app/a": "src/app/a.py", "x/y/b": "b.py", "pp/a": "lib/app/a.py"}
    assert {r.name for r in names.by_suffix(wanted, files, ["project"], unique=True).collect()} == {"src/app/a", "a"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contained_equals_brute_force(spark):
    rng = random.Random(7)
    words = ["alpha", "be", "gamma", "é", "日本", "  ", "x", "delta-y", "\n"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 80))) for _ in range(60)] + ["", None, "z" * 500]
    needles = ["", None, "x", "é", "be", "本", "zzzz", "zzzzzzzz", "z" * 100, "nowhere at all in these texts", "q"]
    for t in texts[:30]:
        for _ in range(4):
            if t:
                a = rng.randrange(len(t))
                needles.append(t[a : a + rng.choice([1, 3, 7, 9, 22, 23, 24, 60, 1000])])
    n = spark.createDataFrame(list(enumerate(needles)), "item int, body string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc long, body string").repartition(3)
    found = context.contained(n, d, needle="item", text="doc")
    got = [(r.item, r.doc) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, k) for i, x in enumerate(needles) for k, t in enumerate(texts) if x and t and x in t}
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert context.contained(n.limit(0), d, needle="item", text="doc").count() == 0 and context.contained(n, d.limit(0), needle="item", text="doc").count() == 0


def test_owners_prefer_the_origin(spark):
    files = spark.createDataFrame([("p", "a.js", "x = function handler() { return 1 }"), ("p", "b.js", "function handler() { return 1 } // b"), ("q", "a.js", "function handler() { return 1 }"), ("p", "c.js", "function other(a, b) { return 22 }")], "project string, path string, body string")
    handlers = spark.createDataFrame([("p", 1, "a.js", "function handler() { return 1 }"), ("p", 2, "z.js", "function handler() { return 1 }"), ("p", 3, "z.js", "function other(a, b) {"), ("q", 4, None, "function handler() { return 1 }"), ("q", 5, "a.js", "function other(a, b) {")], "project string, handler int, origin string, body string")
    got = {(r.project, r.handler, r.path, r.ambiguous) for r in context.owners(handlers, files, ["project"]).collect()}
    assert got == {("p", 1, "a.js", False), ("p", 2, "a.js", True), ("p", 2, "b.js", True), ("p", 3, "c.js", False), ("q", 4, "a.js", False)}


def brute_reach(origins, size, hops, asked, held, files=8, chars=24_000, one=6_000, depth=6):
    taken, lost = {}, {}
    for o, starts in origins.items():
        used, spent, met = 0, 0, set()
        level, n = set(starts), 0
        while level:
            if n > depth:
                lost |= {(o, p): "depth" for p in level}
                break
            met |= level
            score = lambda p: len(asked.get(o, set()) & held.get(p, set()))  # noqa: B023, E731
            after = []
            for p in sorted(level, key=lambda p: (-score(p), p)):
                if p not in size:
                    lost[o, p] = "unknown"
                elif used >= files or spent >= chars:
                    lost[o, p] = "budget"
                else:
                    got = min(size[p], one, chars - spent if n == 0 else (chars - spent) // max(1, files - used))
                    used, spent = used + 1, spent + got
                    taken[o, p] = (n, used, got, got < size[p])
                    after.append(p)
            level, n = {t for p in after for t in hops.get(p, ())} - met, n + 1
    return taken, lost


@pytest.mark.parametrize("seed", [1])
def test_reach_within_budgets_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    size = {f"f{k}": rng.choice([0, 10, 3000, 7000, 20_000]) for k in range(30)}
    hops = {p: {f"f{rng.randrange(34)}" for _ in range(rng.randrange(4))} for p in size} | {f"deep{k}": {f"deep{k + 1}"} for k in range(12)}
    size |= {f"deep{k}": 5 for k in range(12)}
    origins = {f"o{k}": {f"f{rng.randrange(32)}" for _ in range(1 + k % 3)} for k in range(12)} | {"deep": {"deep0"}, "none": {"missing"}}
    words = [f"n{k}" for k in range(8)]
    asked = {o: set(rng.sample(words, 3)) for o in origins}
    held = {p: set(rng.sample(words, 4)) for p in size}
    rows = lambda d: [(k, x) for k, v in d.items() for x in v]
    table = lambda d, a, b: spark.createDataFrame(rows(d) * 2, f"{a} string, {b} string")
    files = spark.createDataFrame(list(size.items()), "path string, size int")
    taken, lost = context.budgeted_reach(table(origins, "origin", "path"), files, table(hops, "path", "target"), table(asked, "origin", "name"), table(held, "path", "name"))
    want = brute_reach(origins, size, hops, asked, held)
    assert {(r.origin, r.path): (r.depth, r.place, r.chars, r.truncated) for r in taken.collect()} == want[0]
    assert {(r.origin, r.path): r.reason for r in lost.collect()} == want[1]
    taken, lost = context.budgeted_reach(table(origins, "origin", "path"), files, table(hops, "path", "target"), most_files=3, most_chars=9000, most_of_one=4000, depth=1)
    want = brute_reach(origins, size, hops, {}, {}, 3, 9000, 4000, 1)
    assert {(r.origin, r.path): (r.depth, r.place, r.chars, r.truncated) for r in taken.collect()} == want[0]
    assert {(r.origin, r.path): r.reason for r in lost.collect()} == want[1]
