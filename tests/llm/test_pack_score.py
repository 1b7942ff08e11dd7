import collections
import math
import random
import re
import zlib

import pytest

from corvid.llm import lm_score, packing


def brute_pack(items, capacity):
    bins, out, full = [], [], []
    for n, (size, source, cluster) in enumerate(items):
        pieces, rest = divmod(size, capacity)
        full += [(n, p) for p in range(pieces)]
        if not rest:
            continue
        fits = [(r, b) for b, (r, s, c) in enumerate(bins) if r >= rest and r and (source is None or source not in s) and (cluster is None or cluster not in c)]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append([capacity, set(), set()])
        out.append((n, pieces, rest, b, capacity - bins[b][0]))
        bins[b][0] -= rest
        bins[b][1].add(source)
        bins[b][2].add(cluster)
    return out + [(n, p, capacity, len(bins) + k, 0) for k, (n, p) in enumerate(full)]


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_brute_force(seed):
    rng = random.Random(seed)
    sources = ["hot"] * 8 + [f"s{i}" for i in range(12)] + [None]
    items = [(rng.choice([0, 3, 7, 19, 50, 64, 130, 200]) + rng.randrange(9), rng.choice(sources), rng.choice([1, 1, 1, *range(2, 40), None])) for _ in range(400)]
    items.sort(key=lambda x: -x[0])
    assert packing.pack_items(items, 64) == brute_pack(items, 64)


def test_best_fit_table(spark):
    rng = random.Random(7)
    texts = [None, "", " \n"] + [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 90))) for _ in range(150)]
    texts += ["A b  c", "a B c\n"] * 10
    rows = [(i if i % 50 else None, t, rng.choice(["x", "x", "y", "z", None]), "c") for i, t in enumerate(texts)] + [(3, "a b c", "y", "c")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id string").repartition(3)
    got = packing.best_fit(df, 40, shard_rows=30).collect()
    n_words = collections.Counter()
    for r in got:
        n_words[r.doc_id] += r.n_words
    want = collections.Counter()
    for i, t, *_ in rows:
        want[i] += len((t or "").split())
    assert n_words == want
    assert sum(r.bin_id is None for r in got) == sum(not (t or "").split() for _, t, *_ in rows)
    bins = collections.defaultdict(list)
    for r in got:
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    known = {(i, len((t or "").split())): (s, (t or "").lower().split()) for i, t, s, _ in rows if i is not None}
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r.bin_start):
            assert r.bin_start == at
            at += r.n_words
        assert at <= 40
        owners = [known[r.doc_id, r.n_words] for r in held if (r.doc_id, r.n_words) in known and r.doc_id != 3]
        sources = [s for s, _ in owners if s is not None]
        assert len(set(sources)) == len(sources)
        clusters = [tuple(w) for _, w in owners]
        assert len(set(clusters)) == len(clusters)
    assert packing.best_fit(df.limit(0)).count() == 0


def brute_scores(rows, order, mass, modulus=7, remainder=2):
    def tokens(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [1]

    held = [zlib.crc32(("" if i is None else str(i)).encode()) % modulus == remainder for i, _ in rows]
    grams = collections.Counter()
    for h, (_, t) in zip(held, rows):
        if not h:
            s = [0, *tokens(t)]
            for m in range(1, order + 1):
                grams.update(tuple(s[k : k + m]) for k in range(len(s) - m + 1))
    unigrams = {g: c for g, c in grams.items() if len(g) == 1 and g != (0,)}
    n, v = sum(unigrams.values()), len(unigrams)

    def chance(context, w):
        if not context:
            return (unigrams.get((w,), 0) + 1) / (n + v + 1)
        return (grams[(*context, w)] + mass * chance(context[1:], w)) / (grams[context] + mass)

    out = []
    for h, (i, t) in zip(held, rows):
        s = [0, *tokens(t)]
        base = sum(math.log10(chance((), w)) for w in s[1:])
        score = sum(math.log10(chance(tuple(s[max(0, k - order + 1) : k]), s[k])) for k in range(1, len(s)))
        out.append((i, h, len(s) - 1, sum((w,) in unigrams for w in s[1:]), n, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order):
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice(["a", "B", "b", "é", "c d", "e\tf", f"w{rng.randrange(30)}"]) for _ in range(rng.randrange(30)))) for i in range(80)]
    rows += [(None, "a b"), (80, None), (81, ""), (82, " \n "), (3, rows[3][1]), (83, "a " * 3000)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    got = lm_score.score_texts(df, order=order, mass=3.0, block_bytes=500, bucket_grams=200).collect()
    key = lambda r: (str(r[0]), r[2], r[6])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute_scores(rows, order, 3.0), key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_scores_of_odd_tables(spark):
    df = spark.createDataFrame([(i, "x y") for i in range(60) if lm_score.is_held_out(i, 7, 2)], "doc_id long, text string")
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.held_out for r in lm_score.score_texts(df).collect())
    assert lm_score.score_texts(df.limit(0)).count() == 0


def test_sequences_hold_every_word_once(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{i}_{k}" for k in range(rng.choice([0, 3, 17, 40, 95]))) for i in range(80)] + [None]
    df = spark.createDataFrame([(i, t, f"s{i % 7}") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)
    placed = packing.best_fit(df, 40, shard_rows=20)
    bins = packing.sequences(df, placed, 40).collect()
    assert len({r.bin_id for r in bins}) == len(bins) and max(r.n_words for r in bins) <= 40
    got = collections.Counter(w for r in bins for w in r.text.split())
    assert got == collections.Counter(w for t in texts if t for w in t.split())
    for r in bins:
        assert len(r.text.split()) == r.n_words == sum(p.n_words for p in r.pieces)
        for p in r.pieces:
            assert set(r.text.split()[p.bin_start : p.bin_start + p.n_words]) <= set(texts[p.id].split())


def test_sequences_keep_texts_as_they_are(spark):
    import hashlib

    rng = random.Random(5)
    spaces = [" ", "\n", "\t ", "\n\n  ", "\x0b\x0c\r"]

    def text(n):
        return rng.choice(["", "  ", "\n"]) + "".join(f"é{rng.randrange(99)}" + rng.choice(spaces) for _ in range(n)) + rng.choice(["", "end", " \n "])

    rows = [(i, text(rng.choice([1, 5, 12, 39, 40, 41, 95, 400])), f"s{i % 9}" if i % 10 else None) for i in range(90)]
    rows += [(None, text(7), "x"), (None, None, "x"), (5, " \n", None), (7, "other text of an id", "y"), rows[3], rows[3], (91, "", "z"), (92, "\u00a0 \u2003", None), (93, "w " * 30_000, "hot")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, source string, bin_id long, piece string").repartition(3)
    got = packing.packed_pieces(df, 40, shard_rows=20).collect()
    blank = lambda t: not re.search(r"[^\x20\x09-\x0D]", t or "")
    assert sorted((r.doc_id or -1) for r in got if r.bin_id is None) == sorted((i or -1) for i, t, _ in rows if blank(t))
    assert all(r.sequence_sha256 is None and r.n_words == 0 for r in got if r.bin_id is None)

    once = [(i, t, s) for i, t, s in rows[:90] + rows[-1:]]
    keyed = spark.createDataFrame(once, "doc_id long, text string, source string").repartition(3)
    bins = packing.sequences(keyed, packing.best_fit(keyed, 40, shard_rows=20), 40).collect()
    pieces = collections.defaultdict(dict)
    for b in bins:
        assert b.text == "\n".join(b.text[p.char_start : p.char_start + p.n_chars] for p in b.pieces)
        for p in b.pieces:
            pieces[p.id][p.piece] = b.text[p.char_start : p.char_start + p.n_chars]
    want = {i: t for i, t, _ in once if not blank(t)}
    assert {i: "".join(t for _, t in sorted(by.items())) for i, by in pieces.items()} == want

    # digests by brute force: cut each text, then join what stands in a bin
    def cut(t):
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+\Z)?", t or "")
        return ["".join(units[k : k + 40]) for k in range(0, len(units), 40)]

    texts = collections.defaultdict(set)
    for i, t, _ in rows:
        for k, piece in enumerate(cut(t)):
            texts[i, k, len(re.findall(r"[^\x20\x09-\x0D]+", piece)), len(piece)].add(piece)
    held = collections.defaultdict(list)
    for r in got:
        if r.bin_id is not None:
            held[r.bin_id].append((r.bin_start, r.char_start, texts[r.doc_id, r.piece, r.n_words, r.n_chars], r.sequence_sha256))
    count = collections.Counter(len(cut(t)) for _, t, _ in rows)
    assert sum(map(len, held.values())) == sum(k * n for k, n in count.items())
    for places in held.values():
        places.sort()
        assert all(len(t) == 1 for *_, t, _ in places)
        joined = "\n".join(next(iter(t)) for *_, t, _ in places)
        assert {d for *_, d in places} == {hashlib.sha256(joined.encode()).hexdigest()}
        assert places[-1][1] + len(next(iter(places[-1][2]))) == len(joined)
    assert packing.packed_pieces(df.limit(0)).count() == 0


def test_given_clusters_never_share_a_bin(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(rng.randrange(1, 9))), None, f"c{rng.randrange(12)}" if i % 4 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, component string").repartition(3)
    clusters = {i: c for i, _, _, c in rows}
    got = packing.packed_pieces(df, 40, cluster_col="component").collect()
    assert sorted(r.doc_id for r in got) == sorted(clusters)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.bin_id].append(clusters[r.doc_id])
    for held in bins.values():
        known = [c for c in held if c is not None]
        assert len(set(known)) == len(known)
    assert len(bins) < 60
