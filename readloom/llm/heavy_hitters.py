"""Problem 5: most frequent values by combinatorial group testing.

Every value has a 64-bit fingerprint. Each of `depth` hash rows puts it into one of `width` buckets, and each
bucket keeps its total and 64 per-bit counters. The counters are ordinary partial aggregates, so each
task holds at most depth x width buckets (bounded memory) and the sketches of all partitions are added by
Spark's final aggregate. A bucket in which one value has the majority spells out that value's fingerprint.
Candidates are then counted exactly.

The width follows from the data: no more than rows / least_rows values can be answers, and there are eight buckets for each. A bucket is settled
once its total less the exact counts of the answers in it is below least_rows. An answer not yet found has only unsettled buckets, so
the rows that do are hashed anew, by another seed, until none are left; after `most_rounds` what is left is counted plainly. So no answer is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.session import written

LEAST_WIDTH, MOST_WIDTH = 1024, 1 << 16


def _buckets(h: str, depth: int, width: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(h, F.lit(seed * 1000 + r)), F.lit(width)).cast("int") for r in range(depth)]


def _sketch(hashed: DataFrame, least_rows: int, depth: int, width: int, seed: int) -> list:
    """(r, b, n, h) of the buckets that reach least_rows, h being the fingerprint their bits spell: at most depth x rows / least_rows."""
    spread = hashed.select("h", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), b.alias("b")) for r, b in enumerate(_buckets("h", depth, width, seed))])).alias("x")).select("h", "x.r", "x.b")
    bits = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    full = spread.groupBy("r", "b").agg(F.count("*").alias("n"), *bits).where(F.col("n") >= least_rows)
    word = reduce(lambda a, i: a.bitwiseOR(F.when(F.col(f"b{i}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), range(64), F.lit(0).cast("bigint"))
    home = reduce(lambda a, x: F.when(F.col("r") == x[0], x[1]).otherwise(a), enumerate(_buckets("h", depth, width, seed)), F.lit(-1))
    return full.select("r", "b", "n", word.alias("h")).withColumn("ok", home == F.col("b")).collect()


def frequent_values(df: DataFrame, column: str, least_rows: int, depth: int = 4, width: int | None = None, most_rounds: int = 4) -> DataFrame:
    """(value, n_rows, n_estimated): all values of a string column held by at least least_rows rows.

    n_rows is exact (verification pass), n_estimated the sketch's count (never below n_rows). Null and empty values do not count. The driver and the
    broadcasts hold at most depth x rows / least_rows buckets and fingerprints; if that exceeds depth x 65,536, sketch rounds are skipped and values are counted plainly.
    """
    spark = df.sparkSession
    schema = "value string, n_rows bigint, n_estimated bigint"
    hashed = df.select(F.col(column).alias("value")).where(F.length("value") > 0).withColumn("h", F.xxhash64("value"))
    rows, least_rows = hashed.count(), max(least_rows, 1)
    answers = rows // least_rows
    if not answers:
        return spark.createDataFrame([], schema)
    width = width or max(LEAST_WIDTH, 1 << (8 * answers - 1).bit_length())
    rest, found = hashed, []
    for seed in range(most_rounds if answers <= MOST_WIDTH else 0):
        buckets = _buckets("h", depth, min(width, MOST_WIDTH), seed)
        sketch = _sketch(rest, least_rows, depth, min(width, MOST_WIDTH), seed)
        estimate: dict[int, int] = {}
        for x in sketch:
            if x["ok"]:
                estimate[x["h"]] = min(estimate.get(x["h"], x["n"]), x["n"])
        left = {(x["r"], x["b"]): x["n"] for x in sketch}
        if estimate:
            candidates = F.broadcast(spark.createDataFrame(list(estimate.items()), "h bigint, n_estimated bigint"))
            exact, _ = written(rest.join(candidates, "h").groupBy("value", "h", "n_estimated").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= least_rows), "frequent")
            found.append(exact)
            counted = exact.select("h", "n_rows", *[b.alias(f"b{r}") for r, b in enumerate(buckets)]).collect()
            for x in counted:
                for r in range(depth):
                    left[r, x[f"b{r}"]] -= x["n_rows"]
            if counted:  # every value of such a fingerprint has been counted
                rest = rest.join(F.broadcast(spark.createDataFrame([(x["h"],) for x in counted], "h bigint").distinct()), "h", "left_anti")
        unsettled = [(r, b) for (r, b), n in left.items() if n >= least_rows]
        if len({r for r, _ in unsettled}) < depth:
            break
        marks = spark.createDataFrame(unsettled, "r int, b int")
        for r in range(depth):
            rest = rest.withColumn("__b", buckets[r]).join(F.broadcast(marks.where(F.col("r") == r).select(F.col("b").alias("__b"))), "__b", "left_semi").drop("__b")
    else:
        found.append(rest.groupBy("value").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= least_rows).withColumn("n_estimated", F.col("n_rows")))
    out = [f.select("value", "n_rows", "n_estimated") for f in found]
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)
