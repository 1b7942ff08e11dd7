from corvid.llm import jaccard_join


def test_near_copies_go_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (5, a + " more"), (5, b), (6, c), (6, c.upper()), (None, d), (None, d.upper()), (None, a), (7, ""), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in jaccard_join.without_near_copies(df).collect()]
    assert sum(i == 6 for i, _ in got) == 1 and sum(i is None for i, _ in got) == 1
    assert {r for r in got if r[0] not in (6, None)} == {(1, a), (5, b), (7, ""), (7, None)} and len(got) == 6
    assert {t.lower() for i, t in got if i is None} == {d}
