"""Global order over several ranges: exact chunk sizes, neighbours and running sums across range ends."""

import random

import pytest
from pyspark.sql import functions as F

from readloom.operators.order import Ordered
from readloom.operators.route import even_chunks, singletons
from readloom.operators.stats import longest_subreads


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_even_chunks_of_many_rows(spark, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.range(4_000_000).select(F.xxhash64("id").alias("v"), F.lit(3).alias("chunk0"))
        out = even_chunks(df, "v", 7)
        rows = {r.chunk: (r.n, r.lo, r.hi) for r in out.groupBy("chunk").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    base, rest = divmod(4_000_000, 7)
    assert [rows[i][0] for i in range(7)] == [base + (i < rest) for i in range(7)] and len(rows) == 7
    assert all(rows[i][2] < rows[i + 1][1] for i in range(6))


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_rows_than_chunks(spark, n):
    assert sorted(r.chunk for r in even_chunks(spark.range(n), "id", 5).collect()) == list(range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    out = [(f"f{i % 3 if i % 7 else 0}", i, rnd.choice([None, 1, 1, 2, 3]), rnd.randrange(100), "x") for i in range(3000)]
    rnd.shuffle(out)
    return out


def test_neighbours_and_sums(spark, rows):
    df = spark.createDataFrame(rows, "file string, read_idx int, hole int, length int, __p2 string").repartition(5)
    want = sorted(rows, key=lambda r: r[:2])
    got = {(r.file, r.read_idx): r for r in Ordered(df, "file", "read_idx").with_neighbours("hole", "file").running(F.col("length"), "s").collect()}
    total = 0
    for i, r in enumerate(want):
        total += r[3]
        g = got[r[:2]]
        assert g.s == total
        assert (g["__prev_hole"], g["__prev_file"]) == ((want[i - 1][2], want[i - 1][0]) if i else (None, None))
        assert (g["__next_hole"], g["__next_file"]) == ((want[i + 1][2], want[i + 1][0]) if i + 1 < len(want) else (None, None))
    numbered, n = Ordered(df, "file", "read_idx").numbered("i")
    assert n == len(rows) and [(r.file, r.read_idx) for r in numbered.orderBy("i").collect()] == [r[:2] for r in want]


def test_longest_of_adjacent_rows(spark, rows):
    df = spark.createDataFrame(rows, "file string, read_idx int, hole_number int, length int, g string")
    want, last = [], None
    for f, _, h, n, _ in sorted(rows, key=lambda r: r[:2]):
        if last is not None and h is not None and last[:2] == [f, h]:
            last[2] = max(last[2], n)
        else:
            last = [f, h, n]
            want.append(last)
    got = longest_subreads(df, ["file", "read_idx"]).collect()
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r.hole_number, r.length) for r in got), key=key) == sorted(((h, n) for _, h, n in want), key=key)


def test_singletons(spark, rows):
    df = spark.createDataFrame(rows, "file string, read_idx int, b int, length int, g string")
    want = sorted(rows, key=lambda r: r[:2])
    alone = set()
    for i, r in enumerate(want):
        beside = [want[j] for j in (i - 1, i + 1) if 0 <= j < len(want)]
        if not any(x[0] == r[0] and x[2] == r[2] for x in beside):
            alone.add(r[:2])
    assert {(r.file, r.read_idx) for r in singletons(df, base=F.col("b")).collect()} == alone and alone
