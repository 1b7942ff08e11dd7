import random

import corpus_pipeline
from corvid.llm import queries
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_lines import made
from tests.llm.test_near import brute_jaccard
from tests.llm.test_texts import brute_figures, brute_rejected


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = made(rng, 40)
    texts += [texts[-1], texts[-2], " ".join(f"w{i}***" for i in range(40)), "one two three four five " * 8, "few words only"]
    texts += [t + "\n" + " ".join(f"n{k}{i}" for i in range(30)) for k, t in enumerate(texts[:10]) if t]
    long = " ".join(f"v{i}" for i in range(5000))
    near = [long, long.replace("v7 ", "u7 "), long.replace("v70 ", "u70 ")]
    texts += ["\n".join(x.split(" ")[k : k + 4].__str__() for k in range(0, 400, 4)) for x in near]  # near copies in short lines
    rows = [(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = [(i, t) for i, t, *_ in rows]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"{n}.parquet"))
        docs = spark.read.parquet(str(tmp_path / f"{n}.parquet"))
        if name == "quality_rules":
            kept = {r.doc_id for r in docs.collect()}
            assert kept == {i for i, t in want if not brute_rejected(t)}
            assert {i for i, t in want if brute_figures(t)[5] or (t and "***" in t)} & kept == set()
            want = [(i, t) for i, t in want if i in kept]
        elif name == "line_dedup":
            want = [(i, new) for (i, _), (new, _, _, emptied) in zip(want, brute_lines(want)) if not emptied]
        elif name == "ngram_jaccard_join":
            components = brute_jaccard([t for _, t in want])[1]
            want = [x for k, x in enumerate(want) if components[k] == k]
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want)
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    sizes: dict = {}
    for r in docs.collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.n_words
    assert sizes == {i: len(t.split()) for i, t in want}
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "n_words").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "n_words").collect()))


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_stages_of_odd_tables(spark, tmp_path):
    clean = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    names = ["id", "n_lines", "n_removed", "emptied", "w", "key", "component", "sig", "row", "at", "good", "gone", "shard", "bin_id"]
    rows = [(1, clean[0], None, None, 1), (None, clean[1], "en", "s", 2), (3, clean[2], "en", None, 3), (3, clean[2], "en", None, 3), (4, None, None, None, None), (5, "", "", "", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, *names) for r in rows], schema)
    for table, ids in ((docs, [None, 1, 3, 3]), (docs.limit(0), [])):
        out = table
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, out, "")
            out.write.parquet(str(tmp_path / f"{len(ids)}-{n}"))
            out = spark.read.parquet(str(tmp_path / f"{len(ids)}-{n}"))
            if name != "best_fit_packing":
                assert out.columns == docs.columns
                assert all([r[x] for x in names] == names for r in out.collect())
            assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(ids, key=str), name
