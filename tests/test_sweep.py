import random

from pyspark.sql import functions as F

from corvid.operators import closure, sweep


def nested(rng, start, end, depth, out):
    """Random intervals within each other or apart."""
    at = start
    while at < end and depth:
        a = rng.randrange(at, end + 1)
        b = rng.randrange(a, end + 1)
        out.append((a, b))
        if b > a:
            nested(rng, a, b, depth - 1, out)
        at = b + rng.randrange(3)
        if rng.random() < 0.3:
            break


def test_innermost_scope_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    intervals, points = [], []
    for g in range(6):
        made = []
        nested(rng, 0, 60 if g else 900, 5 if g else 9, made)
        intervals += [(g, a, b, f"s{k}") for k, (a, b) in enumerate(dict.fromkeys(made))]
        points += [(g, rng.randrange(-3, 66 if g else 950), k) for k in range(40 if g else 400)]
    points += [(0, None, 9000), (77, 5, 9001), (None, 5, 9002)]
    lines = spark.createDataFrame(intervals, "g int, start long, end long, name string")
    asked = spark.createDataFrame(points, "g int, at long, id int")
    want = {}
    for g, at, i in points:
        over = [(b - a, n) for x, a, b, n in intervals if x == g and at is not None and a <= at < b]
        want[g, i] = min(over)[1] if over else None
    for rows_a_block in (50_000, 3):
        got = sweep.innermost(asked, lines, ["g"], rows_a_block=rows_a_block).collect()
        assert len(got) == len(points) and {(r.g, r.id): r.name for r in got} == want
    assert sweep.innermost(asked.limit(0), lines, ["g"]).count() == 0
    assert {r.name for r in sweep.innermost(asked, lines.limit(0), ["g"]).collect()} == {None}


def test_equal_and_empty_intervals(spark):
    lines = spark.createDataFrame([(1, 0, 10, "b"), (1, 0, 10, "a"), (1, 4, 4, "none"), (1, 10, 12, "next")], "g int, start int, end int, name string")
    asked = spark.createDataFrame([(1, 4), (1, 10), (1, 12)], "g int, at int")
    assert {r.at: r.name for r in sweep.innermost(asked, lines, ["g"]).collect()} == {4: "b", 10: "next", 12: None}


def test_best_covers_of_overlapping_intervals(spark):
    rng = random.Random(3)
    intervals = [(k % 3, a := rng.randrange(0, 250), rng.randrange(a, 257), rng.randrange(50)) for k in range(120)]
    points = [(g, at) for g in range(4) for at in range(0, 256, 5)]
    got = sweep.best_covers(spark.createDataFrame(points, "g int, at int"), spark.createDataFrame(intervals, "g int, start int, end int, best int"), ["g"], "at", "best", bits=8)
    assert {(r.g, r.at): r.best for r in got.collect()} == {(g, at): min((v for x, a, b, v in intervals if x == g and a <= at < b), default=None) for g, at in points}


def brute_spans(spans, limit, marker):
    taken, left = [], limit
    for p, a, b in sorted({s for s in spans if s[1] is not None and s[1] < s[2]}, key=lambda s: (s[0], s[2] - s[1], s[1])):
        run = [x for x in range(a, b) if not any(s <= x < e for s, e in [(t[0], t[2]) for t in taken])]
        parts = []
        for x in run:
            if parts and parts[-1][1] == x:
                parts[-1][1] = x + 1
            else:
                parts.append([x, x + 1])
        for s, e in parts:
            taken.append((s, min(e, s + max(left, 0)), e))
            left -= e - s + marker
    return sorted((s, e) for s, e, _ in taken if e > s)


def test_spans_by_priority_within_a_budget(spark):
    rng = random.Random(4)
    rows = [(g, rng.randrange(4), a := rng.randrange(0, 200), rng.randrange(a, 220)) for g in range(12) for _ in range(rng.randrange(1, 12))] + [(50, 1, None, 4), (51, 0, 3, 3)]
    spans = spark.createDataFrame(rows, "g int, priority int, start int, end int")
    for limit, marker in ((60, 0), (90, 7), (10_000, 5)):
        got = {}
        for r in sweep.chosen_spans(spans, ["g"], limit, marker, bits=10).collect():
            got.setdefault(r.g, []).append((r.start, r.end))
        for g in range(12):
            assert sorted(got[g]) == brute_spans([x[1:] for x in rows if x[0] == g], limit, marker)
        assert 50 not in got and 51 not in got


def test_handler_pairs_of_a_hot_scope(spark):
    rng = random.Random(5)
    routes = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(100), f"r{k}") for k in range(120)] + [(1, None, "lost"), (9, 5, "alone")]
    handlers = [(rng.choice([1, 1, 1, 2]), rng.randrange(100), f"h{k}") for k in range(80)] + [(1, None, "never")]
    r, h = spark.createDataFrame(routes, "scope int, at long, route string"), spark.createDataFrame(handlers, "scope int, at long, handler string")
    want = {(a, b) for s, x, a in routes for t, y, b in handlers if s == t and x is not None and y is not None and y > x}
    for rows_a_block in (2000, 3):
        pairs, counted = closure.handler_pairs(r, h, ["scope"], "at", rows_a_block=rows_a_block)
        got = [(x.route, x.handler) for x in pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == want and counted.count() == 0
        assert all(x.at_of_handler > x["at"] for x in pairs.collect())
        pairs, counted = closure.handler_pairs(r, h, ["scope"], "at", F.col("handler").endswith("7"), most=20, rows_a_block=rows_a_block)
        sizes = {a: sum(1 for x, _ in want if x == a) for _, _, a in routes}
        assert {(x.route, x.handlers) for x in counted.collect()} == {(a, n) for a, n in sizes.items() if n > 20}
        assert {(x.route, x.handler) for x in pairs.collect()} == {(a, b) for a, b in want if sizes[a] <= 20 and b.endswith("7")}
    counts = {x.route: x.handlers for x in closure.later_counts(r.filter("at IS NOT NULL"), h.filter("at IS NOT NULL"), ["scope"], "at", rows_a_block=5).collect()}
    assert counts == {a: n for a, n in sizes.items() if a != "lost"}


def test_scopes_before_a_route(spark):
    routes = spark.createDataFrame([("x", "/a/b", 5), ("x", "/ab", 9), ("y", "/a", 9)], "router string, path string, pos int")
    scopes = spark.createDataFrame([("x", "/a", 3), ("x", "/a/b", 7), ("x", "/", 4), ("y", "/a", 9)], "router string, scope string, pos int")
    got = closure.covering_scopes(routes, scopes, on=["router"], at="pos")
    assert {(r.path, r.scope, r.pos_of_scope) for r in got.collect()} == {("/a/b", "/a", 3), ("/a/b", "/", 4), ("/ab", "/", 4)}


def test_error_handlers_of_routes(spark):
    routes = spark.createDataFrame([("r1", "app", 1, "/a", "/a"), ("r2", "sub", 5, "/x/y", "/a/x/y"), ("r3", "sub", 9, "/z", "/a/z")], "route string, router string, position int, path string, full_path string")
    handlers = spark.createDataFrame([("h1", "sub", 7, "/x", False), ("h2", "sub", 8, None, False), ("h3", "app", 0, "/a/x", True), ("h4", "app", 9, None, True)], "handler string, router string, position int, scope string, global boolean")
    got = {(r.route, r.handler) for r in closure.error_handlers(routes, handlers).collect()}
    assert got == {("r1", "h4"), ("r2", "h1"), ("r2", "h2"), ("r2", "h3"), ("r2", "h4"), ("r3", "h4")}


def test_places_among_the_rows_of_a_hot_key(spark):
    from corvid.operators import dedupe

    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "cold", None]), rng.choice([None, *range(40)]), k) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, id int").repartition(3)
    want, seen = {}, {}
    for k, o, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        want[i] = seen[k] = seen.get(k, 0) + 1
    for rows_a_block in (50_000, 20, 1):
        got = dedupe.placed(df, ["k"], [F.col("o"), F.col("id")], "n", rows_a_block).collect()
        assert {r.id: r.n for r in got} == want and len(got) == 300


def test_spans_of_small_groups_are_dealt_once(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(g, rng.randrange(4), a := rng.randrange(0, 200), rng.randrange(a, 220)) for g in range(12) for _ in range(rng.randrange(1, 12))] + [(None, 1, 3, 9), (3, 1, 7, 90), (3, 1, 7, 90)]
    spans = spark.createDataFrame(rows, "g int, priority int, start int, end int")
    looked, real = [], sweep.best_covers
    monkeypatch.setattr(sweep, "best_covers", lambda points, *a, **b: looked.append(points.count()) or real(points, *a, **b))
    for few in (32, 5, 0):
        monkeypatch.setattr(sweep, "FEW", few)
        got = {}
        for r in sweep.chosen_spans(spans, ["g"], 90, 7, bits=10).collect():
            got.setdefault(r.g, []).append((r.start, r.end))
        assert {g: sorted(v) for g, v in got.items()} == {g: want for g in range(12) if (want := brute_spans([x[1:] for x in rows if x[0] == g], 90, 7))}
    assert looked[0] == 0 < looked[1] < looked[2]
