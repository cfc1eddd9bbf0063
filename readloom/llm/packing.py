"""Problem 8: filling fixed-capacity containers by minimum bin slack.

Items are spread over shards of a bounded size by a hash of their id. Within a shard only the number of items of each length
matters: the largest remaining length opens a container, and a bitset subset-sum over a window of the
remaining lengths finds the multiset that comes closest to the room left; backtracking gives its counts. The
bitset is one integer of `capacity` bits, so a window of w lengths costs w shifts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = 20_000  # items of a shard
MOST_KINDS = 1000  # of containers: a table of parameters


def closest_multiset(lengths: list[int], counts: dict[int, int], room: int, window: int) -> dict[int, int]:
    """Counts of lengths (ascending, with their available counts) whose sum is closest to room from below, over a window of those that fit:
    the largest half, and an even spread over the smaller ones, so that two middling items need not leave a gap."""
    mask, reach, steps = (2 << room) - 1, 1, []
    fit = bisect_right(lengths, room)
    near = max(0, fit - window // 2)
    spread = range(near - 1, -1, -max(1, near // (window // 2)))
    for at in chain(range(fit - 1, near - 1, -1), spread):
        if reach >> room & 1:
            break
        size = lengths[at]
        left = min(counts[size], room // size)
        take = 1
        while left and not reach >> room & 1:  # 1, 2, 4, ... copies: every count up to `left` can be reached
            take = min(take, left)
            steps.append((size, take, reach))
            reach |= reach << size * take & mask
            left -= take
            take *= 2
    best, chosen = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> best & 1:
            best -= size * take
            chosen[size] = chosen.get(size, 0) + take
    return chosen


def pack(sizes: list[int], capacity: int, window: int = 48) -> list[list[tuple[int, int, int]]]:
    """Containers as lists of (item index, start, stop); items longer than capacity are cut, others never."""
    bins: list[list[tuple[int, int, int]]] = []
    stock: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for i, n in enumerate(sizes):
        start = 0
        while n - start > capacity:
            bins.append([(i, start, start + capacity)])
            start += capacity
        if n > start:
            stock[n - start].append((i, start, n))
    counts = {k: len(v) for k, v in stock.items()}
    lengths = sorted(counts)
    while lengths:
        chosen = {lengths[-1]: 1}
        counts[lengths[-1]] -= 1
        for size, k in closest_multiset(lengths, counts, capacity - lengths[-1], window).items():
            chosen[size] = chosen.get(size, 0) + k
            counts[size] -= k
        bins.append([stock[size].pop() for size, k in chosen.items() for _ in range(k)])
        if any(not counts[s] for s in chosen):
            lengths = [s for s in lengths if counts[s]]
    return bins


def pack_items(items: DataFrame, bins: DataFrame, item: str = "doc_id", size: str = "n_tokens", kind: str = "bin_kind", capacity: str = "capacity_tokens", shard_size: int = SHARD) -> DataFrame:
    """(bin_kind, bin_id, capacity_tokens, doc_id, part_no, token_start, token_stop): every item in containers of every kind.

    bins: a small table of kinds (parameters, at most 1000, else ValueError; null or non-positive capacities are left out). Rows with a null id or a size that
    is null or < 1 are left out. An item id is expected once; repeated rows are packed as items of their own. An item is cut, into pieces of
    `capacity` and a rest, only if it is longer than the container. bin_id is unique within a kind.
    """
    kinds = sorted(((r[0], int(r[1])) for r in bins.where(F.col(capacity) > 0).select(kind, capacity).distinct().limit(MOST_KINDS + 1).collect()), key=lambda x: (x[0] is not None, str(x[0]), x[1]))
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers: the table of kinds is a parameter")
    base = items.where(F.col(item).isNotNull() & (F.col(size) > 0)).select(F.col(item).alias("doc_id"), F.col(size).cast("bigint").alias("n"))
    shards = max(1, -(-base.count() // shard_size))
    schema = "bin_kind string, bin_id bigint, capacity_tokens int, doc_id bigint, part_no int, token_start bigint, token_stop bigint"

    def one_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n"])
        ids, sizes, out = pdf["doc_id"].tolist(), pdf["n"].tolist(), []
        shard, which = int(pdf["shard"].iloc[0]), int(pdf["which"].iloc[0])
        name, room = kinds[which]
        for k, content in enumerate(pack(sizes, room)):
            out += [(name, (shard << 32) + k, room, ids[i], a // room, a, b) for i, a, b in content]
        return pd.DataFrame(out, columns=["bin_kind", "bin_id", "capacity_tokens", "doc_id", "part_no", "token_start", "token_stop"])

    spread = base.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(shards))).withColumn("which", F.explode(F.array(*[F.lit(i) for i in range(len(kinds))]).cast("array<int>")))
    return spread.groupBy("which", "shard").applyInPandas(one_shard, schema)


def fill_report(packed: DataFrame) -> DataFrame:
    """(bin_kind, n_bins, n_tokens, n_split, fill): how full the containers of each kind are."""
    per = packed.groupBy("bin_kind", "bin_id", "capacity_tokens").agg(F.sum(F.col("token_stop") - F.col("token_start")).alias("n"), F.count_if(F.col("token_start") > 0).alias("cut"))
    return per.groupBy("bin_kind").agg(F.count("*").alias("n_bins"), F.sum("n").alias("n_tokens"), F.sum("cut").alias("n_split"), (F.sum("n") / F.sum("capacity_tokens")).alias("fill"))
