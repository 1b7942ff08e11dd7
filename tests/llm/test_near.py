import random
import re

import numpy as np
import pytest

from corvid.llm import embedding_dedup, jaccard_join
from corvid.llm.components import connected_components


def roots(n, links):
    label = list(range(n))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return [find(i) for i in range(n)]


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_jaccard(texts, percent=80):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [len(s) for s in sets], roots(len(sets), links), links


def made_texts(rng, groups=12, copies=8):
    vocab = [f"w{i}" for i in range(400)] + ["É", "ß", "x"]
    passage = [rng.choice(vocab) for _ in range(60)]
    texts = [None, "", "  \t", "one", "ONE", "a b c", "A b  c", "a b d"]
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([5, 8, 9, 12, 20, 40, 90, 200]))]
        for k in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [rng.choice(vocab)], [w[at], rng.choice(vocab)]])
            if rng.random() < 0.3:
                w = w[: rng.randrange(4, len(w) + 1)]
            if rng.random() < 0.2:
                w += passage
            texts.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in w))
    texts += ["the same " * 40, "the same " * 41, "the same"]
    rng.shuffle(texts)
    return texts


def test_jaccard_components_equal_brute_force(spark):
    for seed in range(3):
        texts = made_texts(random.Random(seed))
        df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, node int, id string").repartition(3)
        got = {r.doc_id: r for r in jaccard_join.jaccard_components(df).collect()}
        sizes, components, _ = brute_jaccard(texts)
        assert [got[i].n_shingles for i in range(len(texts))] == sizes
        assert [got[i].component_id for i in range(len(texts))] == components
    kept = jaccard_join.without_near_copies(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, c in enumerate(components) if i == c}


@pytest.mark.parametrize("rounds", [1, 4])
def test_jaccard_rounds_settle_large_groups(spark, monkeypatch, rounds):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[: rng.randrange(70, 100)] + [f"t{i}"] * rng.randrange(3)) for i in range(60)] + [" ".join(base[40:] + [f"z{k}" for k in range(i)]) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "LONGEST_LIST", 3)
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "PAIRS_AT_ONCE", 10)
    monkeypatch.setattr(jaccard_join, "PAIRS_A_DOCUMENT", 0)
    monkeypatch.setattr(jaccard_join, "PIECE", 7)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_jaccard(texts)[1]


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(4)
    sketch = rng.integers(0, 5, jaccard_join.SKETCH).astype(np.uint32)
    for _ in range(300):
        n = int(rng.integers(4, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        d = jaccard_join.differing_bits(jaccard_join.parity_bits(a), jaccard_join.parity_bits(b))
        assert d <= len(a) + len(b) - 2 * both
        if 100 * both >= 80 * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
            for boundary in (0, 6, 16, 32, 64):
                assert len(np.intersect1d(jaccard_join.signatures(a, sketch, boundary, 80), jaccard_join.signatures(b, sketch, boundary, 80)))


def test_jaccard_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "q"), (None, None), (5, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 2, 3), (3, 2, 3), (3, 2, 3), (None, 1, None), (None, 0, None), (5, 0, 5)], key=str)
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    n = 300
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(180)] + [(i, i + 1) for i in range(100, 160)]
    label = roots(n, links)
    df = spark.createDataFrame([(a - 50, b - 50) for a, b in links], "a long, b long")
    got = {r.node + 50: r.component + 50 for r in connected_components(df).collect()}
    assert got == {i: label[i] for pair in links for i in pair}
    assert connected_components(df.limit(0)).count() == 0


def brute_cosine(vectors, threshold=0.95):
    units = [embedding_dedup.unit(v) for v in vectors]
    links = [(i, j) for i in range(len(units)) for j in range(i) if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold]
    degree = [0] * len(units)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return degree, roots(len(units), links)


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 40)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 8))
    rows = [list(map(float, v * s + e)) for v in base for s, e in zip((1, 2, 1, 1, 1, 1, 1, 1), rng.normal(size=(8, 8)) * np.array([0, 0, 0.1, 0.2, 0.3, 0.35, 0.5, 1])[:, None])]
    hot = rng.normal(size=8)
    rows += [list(map(float, hot + rng.normal(size=8) * 0.05)) for _ in range(60)] + [list(map(float, hot))] * 5
    rows += [None, [], [0.0] * 8, [float("nan")] * 8, [1.0, None] + [0.0] * 6, [float("inf")] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0], [1e-200] * 8, [1e200] * 8]
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, node int").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    degree, components = brute_cosine(rows)
    assert [got[i].n_links for i in range(len(rows))] == degree
    assert [got[i].component_id for i in range(len(rows))] == components
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_waves_hold_few_rows_of_each_vector(spark, monkeypatch):
    """Cells that rule out nothing: each wave deals out at most a few rows of a vector, whatever the number of cells."""
    monkeypatch.setattr(embedding_dedup, "CELL", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(600, 32)).astype(np.float32)
    rows[::50] = rows[1::50] * 3 + rng.normal(size=(12, 32)) * 0.1
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(rows)], "vec_id long, embedding array<float>").repartition(3)
    dealt, real = [], embedding_dedup._compared
    monkeypatch.setattr(embedding_dedup, "_compared", lambda rows, *a: dealt.append(rows.count()) or real(rows, *a))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    degree, components = brute_cosine(rows)
    assert sum(degree) >= 24 and [got[i].n_links for i in range(600)] == degree and [got[i].component_id for i in range(600)] == components
    assert max(dealt) <= 4 * 600


def test_lists_hold_a_set_once(spark):
    """Copies that come to several tasks send the same rows; a signature's list has each set once."""
    rows = [(s, n, 9) for s in (2, 4) for n in (1, 2, 3) for _ in range(5)] + [(6, 1, 9)] * 5
    sigs = spark.createDataFrame(rows, "sig long, node long, n int").repartition(4)
    for long in (False, True):
        assert sorted((r.sig, r.b, r.a) for r in jaccard_join._pivoted(sigs, long).collect()) == [(s, n, 1) for s in (2, 4) for n in (1, 2, 3)]
