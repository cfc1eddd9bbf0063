from readloom.functions.names import quality_offset


def test_all_rows_count(spark):
    narrow = [("LJK",)] * 1500  # codes that either offset allows
    texts = spark.createDataFrame([*narrow, ("#5I",), ("",), (None,)], "t string").coalesce(1)
    assert quality_offset(texts, "t").first().quality_offset == 33
    assert quality_offset(spark.createDataFrame(narrow, "t string"), "t").first().quality_offset is None
