"""Search without a cap on frequent k-mers."""

import random

from readloom.operators.search import ReadIndex


def test_frequent_kmers_count_by_default(spark):
    rnd = random.Random(7)
    hot, other = ("".join(rnd.choice("ACGT") for _ in range(60)) for _ in range(2))
    rows = [(i, hot) for i in range(80)] + [(80, other), (81, hot[:30] + other[:30])]
    reads = spark.createDataFrame(rows, "read_id bigint, seq string")
    queries = spark.createDataFrame([(0, hot), (5, hot.lower()), (80, other)], "query bigint, seq string")
    got = {(r.query, r.read_id): r.hits for r in ReadIndex.build(reads, 14).search(queries).collect()}
    whole = {(q, i): 47 for q in (0, 5) for i in range(80)} | {(q, 81): 17 for q in (0, 5)} | {(80, 80): 47, (80, 81): 17}
    assert got == whole
    capped = {(r.query, r.read_id) for r in ReadIndex.build(reads, 14).set(most_hits=60).search(queries).collect()}
    assert capped == {(80, 80), (80, 81)}


def test_default_has_no_cap(spark):
    assert ReadIndex.build(spark.createDataFrame([(1, "ACGT")], "read_id bigint, seq string"), 3).settings["most_hits"] is None


def test_the_index_as_a_tool(spark, tmp_path):
    import pytest

    rnd = random.Random(2)
    seqs = ["".join(rnd.choice("ACGT") for _ in range(80)) for _ in range(6)]
    reads = spark.createDataFrame(list(enumerate(seqs)) + [(None, seqs[0]), (9, None)], "read_id bigint, seq string")
    index = ReadIndex.build(reads, 20).set(least_value=0.2)
    assert [(r.read_id, r.hits, r.rank_no) for r in index.search_text(seqs[3][:60]).collect()] == [(3, 41, 1)]
    (tmp_path / "q").write_text(seqs[1] + "\n\n" + seqs[4] + "\nACGT\n")
    assert sorted((r.query, r.read_id) for r in index.msearch(str(tmp_path / "q")).collect()) == [(0, 1), (2, 4)]
    index.write(spark.createDataFrame([(7, seqs[5]), (2, seqs[0])], "query bigint, seq string"), str(tmp_path / "out"))
    lines = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == ["2\t0\t61\t1.0", "7\t5\t61\t1.0"]
    assert index.show()["k"] == 20 and index.show()["reads"] == 7 and index.show()["occurrences"] == 6 * 61
    assert "msearch" in index.help() and index.histogram().collect()[0].size == 1
    with pytest.raises(ValueError, match="unknown"):
        index.set(cap=3)
    index.save(str(tmp_path / "index"), 4)
    again = ReadIndex.load(spark, str(tmp_path / "index"), 20)
    assert [(r.read_id, r.hits) for r in again.search_text(seqs[2]).collect()] == [(2, 61)]


def test_offsets_to_reads(spark):
    from readloom.operators.search import offsets_to_reads

    reads = [("b", 1, "x", "ACG"), ("a", 5, "y", "AC"), ("a", 7, "z", None), ("a", 9, "w", ""), ("c", 0, "v", "ACGTA")]
    df = spark.createDataFrame(reads, "file string, read_idx int, name string, seq string")
    offsets = spark.createDataFrame([(i, i) for i in (-1, 0, 1, 2, 4, 5, 9, 10, 4, None)], "offset bigint, pos0 bigint")
    got = sorted((r.offset, r.name, r.pos) for r in offsets_to_reads(offsets, df).collect())
    assert got == [(0, "y", 0), (1, "y", 1), (2, "x", 0), (4, "x", 2), (4, "x", 2), (5, "v", 0), (9, "v", 4)]
    assert offsets_to_reads(offsets.limit(0), df).count() == 0 == offsets_to_reads(offsets, df.limit(0)).count()
