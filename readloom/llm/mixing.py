"""Problem 9: mixing sources to target weights by temperature mixing.

Source token shares q are exponentiated. Without targets the weights are the usual temperature family w_s ~ q_s^x, bisected to a target
entropy. With target shares t they are w_s ~ t_s * (q_s / t_s)^x: the targets themselves at x = 0, the sources' own shares at x = 1, where
nothing is repeated unevenly. x is bisected to the smallest value at which no source exceeds its repetition limit within the token
budget; the source that binds there keeps its limit, and the others are tempered again among themselves over the rest of the budget, so that each
comes as near to its target as the limits allow. The default budget is all tokens of the recipe's sources.

Weights become documents by budgeted block permutations: a source's documents, in hash order,
are cut into blocks with known token sums; whole passes come first, then the blocks of one more
permutation up to the budget, and only the block that straddles it is looked at row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 4096
MOST_TARGETS = 10_000  # rows of the table of targets, which is a table of parameters


def normalised(w: dict[str, float]) -> dict[str, float]:
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if total > 0 else {k: 0.0 for k in w}


def entropy(w: dict[str, float]) -> float:
    return -sum(v * math.log(v) for v in w.values() if v > 0)


def temperature_weights(shares: dict[str, float], target_entropy: float) -> tuple[dict[str, float], float]:
    """(weights, exponent) with weights ~ shares^exponent and the entropy asked for; entropy falls as the exponent grows."""
    q = normalised({k: v for k, v in shares.items() if v > 0})
    low, high = 0.0, 64.0
    at = lambda x: normalised({k: math.exp(x * (math.log(v) - max(map(math.log, q.values())))) for k, v in q.items()})
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(at(mid)) > target_entropy else (low, mid)
    return {**{k: 0.0 for k in shares}, **at(high)}, high


def _bisected(at, fits, low: float, high: float) -> float:
    """The exponent nearest `low` at which the weights fit; `high` must fit."""
    if fits(at(low)):
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(at(mid)) else (mid, high)
    return high


def tempered_weights(target: dict[str, float], tokens: dict[str, int], most: dict[str, int], budget: float) -> tuple[dict[str, float], dict[str, float]]:
    """(weights, exponents) of the sources within their repetition limits; exponent 0: the source has its target's part of what the limited ones leave.

    Sources without tokens, target or repeats have weight 0, the others share it. Weights add up to 1, or to less if every source is at its limit.
    """
    limit = {s: most[s] * tokens.get(s, 0) / budget for s in target} if budget > 0 else {}
    free = {s for s in limit if target[s] > 0 and limit[s] > 0}
    weights, exponents = {s: 0.0 for s in target}, {s: 0.0 for s in target}
    while free:
        rest = max(1.0 - sum(weights.values()), 0.0)
        names = sorted(free)
        lt, lq = ({s: math.log(v) for s, v in normalised({s: x[s] for s in names}).items()} for x in (target, tokens))
        at = lambda x: {s: w * rest for s, w in normalised({s: math.exp((1 - x) * lt[s] + x * lq[s]) for s in names}).items()}  # noqa: B023, E731
        fits = lambda w: all(w[s] <= limit[s] * (1 + 1e-12) for s in names)  # noqa: B023, E731
        x = _bisected(at, fits, 0.0, 1.0) if fits(at(1.0)) else 1.0
        w = at(x)
        bound = names if x == 0.0 else [s for s in names if w[s] >= limit[s] * (1 - 1e-9)]
        for s in bound:
            weights[s], exponents[s] = min(w[s], limit[s]), x
        free -= set(bound)
        if not bound:  # rounding alone
            break
    return weights, exponents


def entropy_weights(tokens: dict[str, int], most: dict[str, int], budget: float, target_entropy: float) -> tuple[dict[str, float], dict[str, float]]:
    """(weights, exponents) of the family q^x with the entropy asked for, or as near to it as the repetition limits allow (x then moves towards 1)."""
    live = {s: n for s, n in tokens.items() if n > 0 and most.get(s, 0) > 0}
    if not live or budget <= 0:
        return {s: 0.0 for s in most}, {s: 0.0 for s in most}
    q = normalised(live)
    at = lambda x: normalised({s: math.exp(x * (math.log(v) - math.log(max(q.values())))) for s, v in q.items()})
    fits = lambda w: all(w[s] * budget <= most[s] * live[s] * (1 + 1e-12) for s in live)
    _, x = temperature_weights(q, target_entropy)
    if not fits(at(x)) and fits(at(1.0)):
        x = _bisected(at, fits, x, 1.0)
    w = at(x)
    return {s: min(w.get(s, 0.0), most[s] * live.get(s, 0) / budget) for s in most}, {s: x for s in most}


def mix_sources(sized: DataFrame, targets: DataFrame, budget: float | None = None, target_entropy: float | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(chosen, report) of every recipe.

    sized: doc_id, source, n_tokens, one row per document, best a written table; documents with a null source or id or without tokens are left out.
    targets: recipe, source, target_share, max_repeats (a parameter table of at most 10,000 rows, else ValueError; null counts as 0). budget: tokens of a mixture, by default as many as
    all the recipe's sources with a target have. target_entropy (nats): temperature family of the sources' own shares instead of target shares.
    chosen: recipe, doc_id, source, n_tokens, repeats (1..max_repeats);
    report: recipe, source, target_share, reached_share, source_tokens, mixed_tokens, mean_repeats, exponent.
    """
    spark = sized.sparkSession
    docs = sized.where("source is not null and doc_id is not null and n_tokens > 0").select("doc_id", "source", "n_tokens")
    wanted = [r.asDict() for r in targets.groupBy("recipe", "source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("most")).where("source is not null").limit(MOST_TARGETS + 1).collect()]
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets: the table of targets is a parameter")
    names = sorted({r["source"] for r in wanted})
    tokens = {r[0]: int(r[1]) for r in docs.where(F.col("source").isin(names)).groupBy("source").agg(F.sum("n_tokens")).collect()}  # a row per source of the recipes
    plan = []
    for recipe in sorted({r["recipe"] for r in wanted}):
        rows = [r for r in wanted if r["recipe"] == recipe]
        most = {r["source"]: r["most"] for r in rows}
        target = {r["source"]: r["share"] if most[r["source"]] > 0 else 0.0 for r in rows}
        total = float(sum(tokens.get(s, 0) for s in target if target[s] > 0)) if budget is None else float(budget)
        own = {s: tokens.get(s, 0) for s in most}
        weights, exponents = tempered_weights(target, own, most, total) if target_entropy is None else entropy_weights(own, most, total, target_entropy)
        for r in rows:
            s = r["source"]
            have = tokens.get(s, 0)
            goal = min(weights[s] * total, most[s] * have)
            passes = int(goal // have) if have else 0
            plan.append((recipe, s, float(r["share"]), passes, float(goal - passes * have), most[s], float(exponents[s])))
    plan_df = spark.createDataFrame(plan, "recipe string, source string, target_share double, passes int, rest double, most int, exponent double")
    plan_df = F.broadcast(plan_df)  # as long as the table of targets

    order = F.xxhash64("doc_id", "recipe", F.lit(seed))
    placed = docs.join(plan_df.where("passes > 0 or rest > 0"), "source").withColumn("h", order).withColumn("block", F.pmod(F.shiftrightunsigned("h", 20), F.lit(BLOCKS)))
    keys = ["recipe", "source", "block"]
    sums = placed.groupBy(*keys, "rest").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy("recipe", "source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # at most BLOCKS rows each
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    # per recipe and source the block in which the rest ends (none: all blocks fit); as long as the table of targets
    edge = sums.where("before + n > rest").groupBy("recipe", "source").agg(F.min("block").alias("last"), F.min_by("before", "block").alias("before"))
    kind = F.when(F.col("last").isNull() | (F.col("block") < F.col("last")), 1).when((F.col("block") == F.col("last")) & (F.col("before") < F.col("rest")), 2).otherwise(0)
    marked = placed.join(F.broadcast(edge), ["recipe", "source"], "left").withColumn("kind", kind).drop("last")
    within = Window.partitionBy(*keys).orderBy("h", "doc_id")
    straddling = marked.where("kind = 2").withColumn("end", F.col("before") + F.sum("n_tokens").over(within))
    # the document across the budget is taken if that comes nearer
    straddling = straddling.withColumn("extra", (F.col("end") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int")).drop("end")
    plain = marked.where("kind <> 2").withColumn("extra", (F.col("kind") == 1).cast("int"))
    chosen = plain.unionByName(straddling).withColumn("repeats", F.least(F.col("passes") + F.col("extra"), F.col("most"))).where("repeats > 0").select("recipe", "doc_id", "source", "n_tokens", "repeats")

    mixed = chosen.groupBy("recipe", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"))
    have = spark.createDataFrame([(s, n) for s, n in tokens.items()], "source string, source_tokens bigint")
    report = plan_df.select("recipe", "source", "target_share", "exponent").join(mixed, ["recipe", "source"], "left").join(F.broadcast(have), "source", "left").fillna(0, ["mixed_tokens", "source_tokens"])
    report = report.withColumn("reached_share", F.coalesce(F.col("mixed_tokens") / F.nullif(F.sum("mixed_tokens").over(Window.partitionBy("recipe")), F.lit(0)), F.lit(0.0)))
    report = report.withColumn("mean_repeats", F.coalesce(F.col("mixed_tokens") / F.nullif("source_tokens", F.lit(0)), F.lit(0.0)))
    return chosen, report.select("recipe", "source", "target_share", "reached_share", "source_tokens", "mixed_tokens", "mean_repeats", "exponent")
