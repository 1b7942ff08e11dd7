import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from corvid.llm import mixing, ranges

SPACE = "\x20\t\n\x0b\x0c\r"


def size(text):
    return len(re.findall(rf"[^{SPACE}]+", text or ""))


def brute_targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    """Rounds as the contract words them: share out by weight, cut off at the cap, give the excess to the others."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        level = Fraction(left) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, key int, `group` int").repartition(3)


def docs(seed=1, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = None if i % 17 == 0 else "hot" if rng.random() < 0.4 else f"s{rng.randrange(9)}"
        text = rng.choice([None, "", " \n"]) if rng.random() < 0.05 else " ".join(f"w{k}" for k in range(rng.randrange(1, 60)))
        out.append((i, text, source, "x", 1, 2))
    return out + [(n, "\n ".join(f"v{k}" for k in range(3000)), "s1", "x", 1, 2)]


def brute(rows, seed="mix"):
    """(targets by source, taken by id) for rows of distinct ids."""
    sizes = defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += size(t)
    target, taken = brute_targets(sizes), {}
    for s in sizes:
        own = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:15], i, size(t)) for i, t, x, *_ in rows if x == s)
        epochs, left = divmod(int(target[s]), sizes[s]) if sizes[s] else (0, 0)
        for _, i, n in own:
            taken[i] = epochs * n + min(n, left)
            left -= min(n, left)
    return sizes, target, taken


def test_mixture_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_RANGE", 8)  # many ranges, in two levels
    rows = docs()
    sizes, target, taken = brute(rows)
    got = mixing.mixture(made(spark, rows)).collect()
    by_id = {i: (t, s) for i, t, s, *_ in rows}
    assert sorted(r.doc_id for r in got) == sorted(by_id)
    for r in got:
        text, source = by_id[r.doc_id]
        assert (r["size"], r.source_size) == (size(text), sizes[source])
        assert abs(r.target - target[source]) < 1e-6 and r.taken == taken[r.doc_id] <= 2 * r["size"]
    assert sorted(mixing.mixture(made(spark, rows).repartition(7)).collect()) == sorted(got)  # reruns agree
    assert any(r.epochs == 1 and r.cut for r in got) and len({r.epochs for r in got}) > 1


def test_mix_holds_what_is_taken(spark, monkeypatch):
    rows = docs(2)
    taken = brute(rows)[2]
    for few in (100, 0):  # cuts broadcast, and joined by a shuffle
        monkeypatch.setattr(mixing, "FEW_SOURCES", few)
        words, text = defaultdict(int), {i: t for i, t, *_ in rows}
        for r in mixing.mixed(made(spark, rows)).collect():
            assert (text[r.doc_id] or "").startswith(r.text or "") and r["size"] == "x" and r["group"] == 2
            words[r.doc_id] += size(r.text)
        assert {i: n for i, n in taken.items() if n} == {i: n for i, n in words.items() if n}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(7, "a b c d", "s", "x", 1, 2)] * 50 + [(None, f"n{k} m", None, "x", 1, 2) for k in range(30)] + [(1, None, None, "x", 1, 2), (2, "", "empty", "x", 1, 2)]
    got = mixing.mixture(made(spark, rows)).collect()
    assert len(got) == len(rows) and {r.taken for r in got if r.doc_id == 7} == {7 if False else r.taken for r in got if r.doc_id == 7}
    assert len({r.taken for r in got if r.doc_id == 7}) == 1  # equal rows share evenly
    want = brute_targets({"s": 200, None: 60, "empty": 0})
    for source, ids in (("s", {7}), (None, {None, 1})):
        total = sum(r.taken for r in got if r.doc_id in ids)
        assert want[source] - 50 < total <= want[source]
    assert [r.taken for r in got if r.doc_id in (1, 2)] == [0, 0]
    assert sum(size(r.text) for r in mixing.mixed(made(spark, rows)).collect()) == sum(r.taken for r in got)
    for f in (mixing.mixture, mixing.mixed):
        assert f(made(spark, rows).limit(0)).count() == 0


def test_weights_by_table(spark):
    rows = docs(3)
    weights = spark.createDataFrame([("hot", 1.0), (None, 3.0), ("nowhere", 9.0)], "source string, weight double")
    got = mixing.mixture(made(spark, rows), weights, share=0.2).collect()
    source = {i: s for i, _, s, *_ in rows}
    total, sums = sum(size(t) for _, t, *_ in rows), defaultdict(int)
    for r in got:
        sums[source[r.doc_id]] += r.taken
    cap = 2 * sum(size(t) for _, t, s, *_ in rows if s is None)
    null = min(cap, 0.2 * total * 3 / 4)
    assert abs(sums[None] - null) <= 1 and abs(sums["hot"] - (0.2 * total - null)) <= 1
    assert all(n == 0 for s, n in sums.items() if s not in ("hot", None))


def test_running_sums_over_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, rng.randrange(100), None]), i, rng.randrange(50)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i int, v long")
    got = {r.i: (r.nth, r.before_v) for r in ranges.running(df, [F.desc("k"), F.col("i")], ["v"], rows_a_part=40).collect()}
    before = 0
    for n, (k, i, v) in enumerate(sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1])), 1):
        assert got[i] == (n, before)
        before += v
