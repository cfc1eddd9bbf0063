"""Counts of other alignments where one sequence has very many, and their listing."""

from pyspark.sql import functions as F

from readloom.operators import align as A
from readloom.plans import tables


def test_other_alignments_of_a_hot_sequence_are_counted_not_listed(spark, tmp_path):
    n = 3000
    rows = spark.range(n).selectExpr("id as match_id", "if(id < 2900, 'hot', concat('a', id % 10)) as read1", "concat('b', id) as read2", "200 as read_length", "150 as match_length", "100 as identity", "1 as gap", "0 as flag")
    rows.write.parquet(f"{tmp_path}/pair_match.parquet")
    df = tables.QUERIES["o6_alignment_listing"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_except" not in plan  # a list of n in each of n rows
    got = {(r.name1, r.n_others) for r in df.collect()}
    assert df.count() == n and got == {("hot", 2899)} | {(f"a{i}", 9) for i in range(10)}


def test_counts_are_the_sizes_of_the_listing(spark):
    """Equal alignments count once, worse ones of the same pair count as others, rows without a name1 are left out."""
    data = [("a", "x", 5, 1, 9), ("a", "x", 5, 1, 9), ("a", "x", 5, 0, 8), ("a", "x", 4, 0, 9), ("a", "y", 5, 1, 9), ("b", "x", 7, 2, 3), ("b", "x", 7, 2, 3), (None, "x", 1, 1, 1), ("c", "y", None, 1, 2), ("c", "y", 3, 1, 2)]
    rows = spark.createDataFrame(data, "name1 string, name2 string, score int, start int, stop int")
    listed = A.alignment_listing(rows).withColumn("others", F.size("others").cast("bigint"))
    got = sorted(map(tuple, A.alignment_counts(rows).collect()), key=repr)
    assert got == sorted(map(tuple, listed.collect()), key=repr)
    assert [(r[2], r[0], r[5]) for r in got] == [("a", "x", 3), ("b", "x", 0), ("a", "y", 3), ("c", "y", 1)]
