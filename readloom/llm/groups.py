"""Problem 2: consolidating pairwise matches into groups by low-diameter decomposition.

Every vertex draws an exponentially distributed head start from a hash of its id; clusters grow from their
centres, a vertex joining the cluster that reaches it first (head start minus distance), until no vertex changes its cluster. Clusters
contract to super-vertices, the edges between clusters are kept once, and the step recurses on them until none is left.
Assignments of the levels are then composed, last level first.

Growth needs about as many steps as the greatest head start, ln(vertices) / rate, less on components of small diameter; a level
leaves about a share `rate` of the edges at most between clusters. Only vertices that changed make offers in the next step.

Every step is a hash aggregate or an equi-join on vertex ids: a vertex with a third of all edges is combined
map-side in the aggregates and split by the adaptive skew join in the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.session import drop_table, free_shuffles, written


def head_start(vertex: Column, level: int, rate: float, seed: int) -> Column:
    """Exp(rate) from a hash of the vertex, other for each level."""
    u = (F.pmod(F.xxhash64(vertex, F.lit(seed * 1000 + level)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    return -F.log(u) / rate


def _grow(edges: DataFrame, level: int, rate: float, seed: int, stride: int, most_steps: int) -> tuple[DataFrame, str]:
    """A written table (node, label): the centre that reaches each end of an edge first, grown until no label changes, `stride` steps a job."""
    spark = edges.sparkSession
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    start = lambda x: head_start(F.col(x), level, rate, seed)
    best = [F.max("t").alias("t"), F.max_by("c", "t").alias("c")]  # fixed-width buffers: a hash aggregate; any of equal t will do
    if_, unless = (lambda x: F.when(~F.col("own"), F.col(x))), (lambda x: F.when(F.col("own"), F.col(x)))
    both_best = [F.max(if_("t")).alias("t1"), F.max_by(if_("c"), if_("t")).alias("c1"), F.max(unless("t")).alias("t0"), F.max_by(unless("c"), unless("t")).alias("c0")]
    # every vertex also meets its own label, so that a step is one join and one aggregate
    around = both.select("u", "v", F.lit(False).alias("own")).unionByName(both.select("u").distinct().select("u", F.col("u").alias("v"), F.lit(True).alias("own")))
    # the first step needs no join: a neighbour's label is the neighbour itself
    label = both.select(F.col("u").alias("node"), (start("v") - 1).alias("t"), F.col("v").alias("c")).groupBy("node").agg(*best)
    mine = start("node")
    stays = mine >= F.col("t")
    label = label.select("node", F.greatest("t", mine).alias("t"), F.when(stays, F.col("node")).otherwise(F.col("c")).alias("c"), (~stays).alias("moved"))
    path, step = None, 1
    while True:
        for _ in range(stride):
            met = around.join(label.withColumnRenamed("node", "v"), "v").where("own or moved").select(F.col("u").alias("node"), (F.col("t") - F.when(F.col("own"), 0.0).otherwise(1.0)).alias("t"), "c", "own")
            each = met.groupBy("node").agg(*both_best)
            later = F.coalesce(F.col("t1") > F.col("t0"), F.lit(False))  # a label moves only for an earlier one, so growth ends
            label = each.select("node", F.when(later, F.col("t1")).otherwise(F.col("t0")).alias("t"), F.when(later, F.col("c1")).otherwise(F.col("c0")).alias("c"), later.alias("moved"))
        step += stride
        old, (label, path) = path, written(label, f"labels{level}")
        if old:
            drop_table(spark, old)
        if label.where("moved").isEmpty():
            return label.select("node", F.col("c").alias("label")), path
        if step > most_steps:
            raise RuntimeError(f"clusters still grow after {step} steps")


def connected_groups(links: DataFrame, a: str = "a", b: str = "b", rate: float = 0.2, seed: int = 1, stride: int = 3, most_steps: int = 1000, most_levels: int = 60) -> DataFrame:
    """(id, group_id) of every id linked to another one; group_id is the lowest id linked directly or indirectly.

    links: any number of rows with two bigint ids; direction and repetition do not matter. Rows with a null id and links of an
    id to itself tie nothing. An empty table gives an empty result.
    """
    spark = links.sparkSession
    edges = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok")).where("ok and u < v").select("u", "v").distinct()
    edges, edge_path = written(edges, "edges")
    levels: list[tuple[DataFrame, str]] = []
    for level in range(most_levels):
        if edges.isEmpty():
            break
        labels, path = _grow(edges, level, rate, seed, stride, most_steps)
        levels.append((labels, path))
        x = edges.join(labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u").join(labels.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v")
        smaller = x.where("lu <> lv").select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct()
        old, (edges, edge_path) = edge_path, written(smaller, f"edges{level}")
        drop_table(spark, old)
        free_shuffles(spark)
    else:
        raise RuntimeError(f"{most_levels} levels left edges; each should halve them")
    drop_table(spark, edge_path)
    if not levels:
        return spark.createDataFrame([], "id bigint, group_id bigint")
    final = levels[-1][0]
    for labels, _ in reversed(levels[:-1]):
        up = final.select(F.col("node").alias("label"), F.col("label").alias("top"))
        final = labels.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    lowest = final.groupBy("label").agg(F.min("node").alias("group_id"))
    return final.join(lowest, "label").select(F.col("node").alias("id"), "group_id")
