from meridian.llm.rows import distinct_rows


def test_copies_once_and_differing_rows_kept(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c"), (None, "d"), (None, "d"), (3, None)], "k long, t string")
    assert sorted(map(tuple, distinct_rows(df, "k").collect()), key=str) == sorted([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (3, None)], key=str)
    assert distinct_rows(df.where("k = 3"), "k").count() == 1 and distinct_rows(df.where("false"), "k").count() == 0
