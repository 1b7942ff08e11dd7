from corvid import queries


def test_mounts_beyond_the_default_budget(spark):
    nations = spark.createDataFrame([(0, "A", 0), (1, "B", 0)], "n_nationkey int, n_name string, n_regionkey int")
    suppliers = spark.range(10_050).selectExpr("id AS s_suppkey", "CAST(id % 2 AS INT) AS s_nationkey")
    tables = {"region": spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string"), "nation": nations, "supplier": suppliers}
    reached, cycles = queries._closure(tables.__getitem__)
    assert reached.count() == 1 + 1 + 2 + 10_050
    assert [tuple(r) for r in cycles.collect()] == [("n0", "r0", "/r/a/back")]
