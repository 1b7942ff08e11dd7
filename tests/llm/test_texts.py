import base64
import collections
import random
import re

import public_tokenizers as P
import pytest

from corvid.llm import byte_bpe, quality, token_count

TEXTS = [
    None, "", " ", "a", "Don't  stop\n\n I'll\t99 ok!!", "<|endoftext|>x <|endoftext|>  <|endoftext|>", "a" * 3000, "ab ba" * 700,
    "é" * 2500, "日本語 テキスト 😀😀", "\x1c\x85\xa0　 x", "w " * 12, "one two three four five " * 6, "A\nb c\nA\nA \nb c\n\n\n", "###***&&& $%|<>",
]


def noisy(n=60, seed=3):
    rng = random.Random(seed)
    alphabet = [chr(c) for c in (*range(32, 127), *range(0xC0, 0x180), 0x3042, 0x4E00, 0x1F600, 10, 9, 0xA0)]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(n)]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, id long")


def test_token_counts_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = TEXTS + noisy()
    path = P.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_count.token_counts(table(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024), t
    assert token_count.token_counts(table(spark, ["x"]).limit(0), path).count() == 0


def test_round_trip_equals_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = TEXTS + noisy(seed=4)
    got = {r.doc_id: r for r in byte_bpe.round_trip(table(spark, texts), path, P.PATTERN, with_ids=True).collect()}
    import hashlib
    import struct

    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert (got[i].n_tokens, bytes(got[i].ids)) == (len(ids), raw), t
        assert got[i].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def brute_figures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = collections.Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def brute_rejected(text):
    """Whether the base rule or any rule of the cascade rejects a text."""
    n_words, _, n_symbols, n_dup_lines, _, failed = brute_figures(text)
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        failed or n_symbols > 0.1 * n_words or n_dup_lines > 0.5 * len(lines) or sum(x.endswith("!!") for x in w) > 0.1 * n_words
        or sum(a == b for a, b in zip(w, w[1:])) > 0.3 * n_words or sum(any(c.isalpha() for c in x) for x in w) < 0.4 * n_words
    )


def test_quality_figures_equal_brute_force(spark):
    rng = random.Random(5)
    made = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(40)]
    clean = " ".join(f"word{i}," for i in range(40))
    junk = [" ".join(f"w{i}***" for i in range(30)), " ".join(f"W{i}!!" for i in range(30)), " ".join(f"w{i} w{i}" for i in range(20)), "\n".join(["l m"] + [f"x{i}" for i in range(3)] + ["l m"] * 9), " ".join(str(i) for i in range(30))]
    texts = TEXTS + noisy(seed=6) + made + [clean] + junk
    got = {r.doc_id: r for r in quality.quality_verdicts(table(spark, texts), sample_rows=20).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_figures(t), t
        assert r.kept == (not brute_rejected(t)), t
    at = len(texts) - len(junk) - 1
    assert got[at].kept and not any(got[at + 1 + k].kept for k in range(len(junk)))
    kept = quality.keep_good(table(spark, texts), sample_rows=20)
    assert kept.columns == ["doc_id", "text", "n_tokens", "id"]
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.quality_verdicts(table(spark, ["x"]).limit(0)).count() == 0
