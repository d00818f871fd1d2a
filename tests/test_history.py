from millrace.operators import history


def test_scd2_skips_unchanged_rows_and_adjoins(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, "a"), (2, 1, None)], "k int, at int, s string")
    got = {tuple(r) for r in history.scd2(rows, ["k"], ["s"], ["at"], "at").collect()}
    assert got == {(1, "a", 1, 3, False), (1, None, 3, 4, False), (1, "a", 4, None, True), (2, None, 1, None, True)}
