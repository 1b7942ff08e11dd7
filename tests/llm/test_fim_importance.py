import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvid.llm import fim, importance
from tests.llm.test_texts import TEXTS, noisy, table

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(doc_id, text):
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


MADE = ["  lead\x0bx ", "<P>", "a <S> b", "<<S", "x <M", " \t ", "\x1c\x85 u\x00v", "é 日本 語 w", "< P >", "one", " one", "one ", "<P <S <M > a b c"]


def test_fill_in_middle_equals_brute_force(spark, monkeypatch):
    texts = TEXTS + noisy(seed=8) + MADE * 8 + ["<S" * 40 + " > <P " * 40, "w " * 100_000, " " * 200_000, "x" * 300_000]
    docs = table(spark, texts)
    for chars in (1 << 22, 50):  # batches by size
        monkeypatch.setattr(fim, "_CHARS", chars)
        made = fim.fill_in_middle(docs)
        got = {r.doc_id: r for r in made.select("*", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()}
        for i, t in enumerate(texts):
            r = got[i]
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fim(i, t or ""), t
            assert r.back == (t or "")
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}
    odd = spark.createDataFrame([(None, "a b c", 1), (3, "a b", 2), (3, "c d e", 3)], "doc_id long, text string, n int")
    assert sorted((r.doc_id or -1, *r[1:]) for r in fim.fill_in_middle(odd).collect()) == sorted((i or -1, *brute_fim(i, t)) for i, t in ((None, "a b c"), (3, "a b"), (3, "c d e")))
    assert fim.fill_in_middle(odd.limit(0)).count() == 0


def test_ranks_of_long_runs(monkeypatch):
    monkeypatch.setattr(fim, "_EVENTS", 3)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(" \n\tab<P>S") for _ in range(rng.randrange(40)))
        ranks, units = fim.scanner().ranks(text), UNIT.findall(text)
        assert ranks.units == len(units) and ranks.marked == any(x in text for x in ("<P>", "<S>", "<M>"))
        assert [ranks.end_of(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def features(text, most=1):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute_importance(rows, targets, most=1, buckets=10_000, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t, most)[1])
    t = Counter(bucket(f) for x in targets for f in features(x, most)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out, found = {}, []
    for i, x in rows:
        words, f = features(x, most)
        weight = sum(gain(bucket(y)) for y in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(f), weight, score, None]
        if words >= 20:
            found.append((-score, i))
    for n, (_, i) in enumerate(sorted(found)[: len(found) * percent // 100], 1):
        out[i][3] = n
    return out


@pytest.mark.parametrize("most, buckets", [(1, 10_000), (3, 97)])
def test_importance_equals_brute_force(spark, monkeypatch, most, buckets):
    rng = random.Random(most)
    texts = TEXTS + noisy(seed=9) + [" ".join(rng.choice(["Alpha", "beta", "gamma-x", "Été", "q7", "zz"]) for _ in range(rng.randrange(15, 60))) for _ in range(150)]
    goal = ["Alpha beta beta", None, "", "q7 q7 été Q7"]
    docs, target = table(spark, texts), spark.createDataFrame([(k, t) for k, t in enumerate(goal)], "item_id long, text string")
    want = brute_importance(list(enumerate(texts)), goal, most, buckets)
    for block in (importance.BLOCK, 300):
        monkeypatch.setattr(importance, "BLOCK", block)
        got = importance.resampled(docs, target, most, buckets).collect()
        assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in got} == want and len(got) == len(texts)


def test_importance_of_odd_tables(spark):
    goal = spark.createDataFrame([("x y",)], "text string")
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(5, text)] * 20 + [(None, text), (None, None), (4, "few")], "doc_id long, text string")
    got = importance.resampled(docs, goal, percent=50).collect()
    assert len(got) == 23 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11))  # 21 rows of 20 words or more
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    none = importance.resampled(docs, goal.limit(0)).collect()
    assert len(none) == 23 and importance.resampled(docs.limit(0), goal).count() == 0
