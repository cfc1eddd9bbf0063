"""Alignment tables: pair and containment filters, trimming extents, best matches, duplicate reduction.

A PSL row has matches, mismatches, rep_matches, n_count, q_gap_count, q_gap_bases, t_gap_count, t_gap_bases, strand, q_name, q_size, q_start, q_end,
t_name, t_size, t_start, t_end, block_count, block_sizes, q_starts, t_starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.session import drop_table, written

INSERT = 48  # fixed value: Ns between the mates of a concatenated pair
PSL = (
    "matches mismatches rep_matches n_count q_gap_count q_gap_bases t_gap_count t_gap_bases strand q_name q_size q_start q_end t_name t_size t_start t_end block_count "
    "block_sizes q_starts t_starts"
).split()


def parse_psl(lines: DataFrame, column: str = "value") -> DataFrame:
    """PSL rows from text lines; header lines and short lines are dropped (a row starts with a number and has 21 fields)."""
    f = F.split(F.trim(column), r"\s+")
    ints = lambda x: F.transform(F.filter(F.split(x, ","), lambda y: y != ""), lambda y: y.try_cast("int"))
    text = {"strand", "q_name", "t_name"}
    cols = [f[i].alias(n) if n in text else ints(f[i]).alias(n) if i >= 18 else f[i].try_cast("int").alias(n) for i, n in enumerate(PSL)]
    return lines.where((F.size(f) >= 21) & f[0].rlike("^[0-9]+$")).select(*cols)


def contained_matches(psl: DataFrame, identity: float, forward_only: bool = False) -> DataFrame:
    """Rows whose query is similar (matches + rep_matches >= q_size * identity) and lies within the target, on the row's strand."""
    left, right = F.col("q_start"), F.col("q_size") - F.col("q_end")
    ahead = F.col("strand") == "+"
    room_left, room_right = F.when(ahead, left).otherwise(right), F.when(ahead, right).otherwise(left)
    ok = (F.col("matches") + F.col("rep_matches") >= F.col("q_size") * identity) & (F.col("t_start") >= room_left) & (F.col("t_size") - F.col("t_end") >= room_right)
    return psl.where(ok & (ahead | F.lit(not forward_only)))


def matched_targets(psl: DataFrame) -> DataFrame:
    """(q_name, targets): distinct targets of each query in order."""
    return psl.groupBy("q_name").agg(F.array_sort(F.collect_set("t_name")).alias("targets"))


def _pair_gap(lengths: list[int], ours: list[int], theirs: list[int], our_insert: int, their_insert: int) -> int:
    """Bases from our insert to the nearest base matched outside their insert, the larger of both sides; -1 if a side has none."""
    lo, hi = their_insert, their_insert + INSERT
    pieces = []
    for n, a, b in zip(lengths, ours, theirs, strict=False):
        for s, e in ((b, min(b + n, lo)), (max(b, hi), b + n)):  # what is matched left and right of their insert
            if s < e:
                pieces.append((a + s - b, a + e - b))
    before = [max(0, our_insert - e) for s, e in pieces if s < our_insert]
    end = our_insert + INSERT
    after = [max(0, s - end) for s, e in pieces if e > end]
    return max(min(before), min(after)) if before and after else -1


def pair_matches(psl: DataFrame, identity: float, most_gap: int) -> DataFrame:
    """(read1, read2, read_length, match_length, identity, gap, flag): matches between concatenated pairs ('name-<offset of the insert>') that span the insert.

    Names differ, n_count covers the insert, matches + rep_matches >= identity * match_length, and on both sides of either insert a matched base lies within
    most_gap. The longer sequence comes first (the query if equal, flag 1).
    """
    match_length = F.least("q_size", "t_size") - F.col("n_count")
    good = (F.col("q_name") != F.col("t_name")) & (F.col("n_count") >= INSERT) & (F.col("matches") + F.col("rep_matches") >= match_length * identity)
    rows = psl.where(good).withColumns({
        "ml": match_length,
        "qi": F.when(F.col("strand") == "+", F.substring_index("q_name", "-", -1).try_cast("int")).otherwise(F.col("q_size") - F.substring_index("q_name", "-", -1).try_cast("int") - INSERT),
        "ti": F.substring_index("t_name", "-", -1).try_cast("int"),
    })

    def gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            g = []
            for n, q, t, qi, ti in zip(b.block_sizes, b.q_starts, b.t_starts, b.qi, b.ti, strict=True):
                x, y = _pair_gap(n, q, t, qi, ti), _pair_gap(n, t, q, ti, qi)
                g.append(-1 if min(x, y) < 0 or max(x, y) > most_gap else max(x, y))
            yield b.drop(columns=["block_sizes", "q_starts", "t_starts", "qi", "ti"]).assign(gap=g)

    slim = rows.where("qi is not null and ti is not null").select("q_name", "t_name", "q_size", "t_size", "ml", (F.col("matches") + F.col("rep_matches")).alias("same"), "block_sizes", "q_starts", "t_starts", "qi", "ti")
    out = slim.mapInPandas(gaps, "q_name string, t_name string, q_size int, t_size int, ml int, same int, gap int").where("gap >= 0")
    first = F.col("q_size") >= F.col("t_size")
    return out.select(
        F.when(first, F.col("q_name")).otherwise(F.col("t_name")).alias("read1"), F.when(first, F.col("t_name")).otherwise(F.col("q_name")).alias("read2"), F.greatest("q_size", "t_size").alias("read_length"),
        F.col("ml").alias("match_length"), F.col("same").alias("identity"), "gap", F.when(F.col("q_size") == F.col("t_size"), 1).otherwise(0).alias("flag"),
    )


def spans_insert(psl: DataFrame, offset: int) -> DataFrame:
    """Rows whose blocks hold, on both sequences, a base within `offset` bases of each end of the insert (block variant of the pair filter)."""

    def holds(starts: str, insert: str) -> Column:
        left = F.expr(f"exists(arrays_zip({starts}, block_sizes), z -> z.{starts} < {insert} and z.{starts} + z.block_sizes > {insert} - {offset} - 1)")
        right = F.expr(f"exists(arrays_zip({starts}, block_sizes), z -> z.{starts} <= {insert} + {INSERT} + {offset} and z.{starts} + z.block_sizes > {insert} + {INSERT})")
        return left & right

    rows = psl.withColumns({"__qi": F.when(F.col("strand") == "+", F.substring_index("q_name", "-", -1).try_cast("int")).otherwise(F.col("q_size") - F.substring_index("q_name", "-", -1).try_cast("int") - INSERT), "__ti": F.substring_index("t_name", "-", -1).try_cast("int")})
    return rows.where(holds("q_starts", "__qi") & holds("t_starts", "__ti")).drop("__qi", "__ti")


def blast_filter(rows: DataFrame, least_score: float, most_mismatches: int, most_gaps: int) -> DataFrame:
    """Rows with score above and mismatches and gaps below the limits (all strict)."""
    return rows.where((F.col("score") > least_score) & (F.col("mismatches") < most_mismatches) & (F.col("gaps") < most_gaps))


def inside_reads(psl: DataFrame, identity: float, offset: int) -> DataFrame:
    """(name) of reads that lie inside another one, up to `offset` overhanging bases; of two equal ones the target counts."""
    ahead = F.col("strand") == "+"
    left = F.col("q_start") - F.when(ahead, F.col("t_start")).otherwise(F.col("t_size") - F.col("t_end"))
    right = F.col("q_size") - F.col("q_end") - F.when(ahead, F.col("t_size") - F.col("t_end")).otherwise(F.col("t_start"))
    q_in, t_in = (left <= offset) & (right <= offset), (-left <= offset) & (-right <= offset)
    similar = (F.col("q_name") != F.col("t_name")) & (F.col("matches") + F.col("rep_matches") >= F.least("q_size", "t_size") * identity)
    name = F.when(q_in & (~t_in | (F.col("q_size") < F.col("t_size"))), F.col("q_name")).when(t_in, F.col("t_name"))
    return psl.where(similar).select(name.alias("name")).where("name is not null").distinct()


def trim_extents(psl: DataFrame, least_match: int, identity: float, read_offset: int, trim_offset: int, least_left: int) -> DataFrame:
    """(name, trim_left, trim_right, kept): where reads should be cut because an end of theirs matches the middle of others.

    trim_left is the furthest end of matches at the front (1 if none), trim_right the nearest start of matches at the back (size - 1); kept tells whether
    trim_right - trim_left >= least_left.
    """
    same = F.col("matches") + F.col("rep_matches")
    long_ = same + F.col("mismatches") + F.col("n_count")
    rows = psl.where((F.col("q_name") != F.col("t_name")) & (same >= least_match) & (same >= (long_ + F.col("q_gap_bases")) * identity) & (same >= (long_ + F.col("t_gap_bases")) * identity))
    side = lambda x: F.struct(F.col(f"{x}_name").alias("name"), F.col(f"{x}_size").alias("size"), F.col(f"{x}_start").alias("start"), F.col(f"{x}_end").alias("end"), (F.col(f"{x}_size") - F.col(f"{x}_end")).alias("rest"))
    both = rows.select(F.explode(F.array(F.struct(side("q").alias("a"), side("t").alias("b")), F.struct(side("t").alias("a"), side("q").alias("b")))).alias("x")).select("x.a", "x.b")
    at_end = (F.col("a.start") <= read_offset) | (F.col("a.rest") <= read_offset)
    middle = (F.col("b.start") >= trim_offset) & (F.col("b.rest") >= trim_offset)
    g = both.where(at_end & middle).groupBy("a.name").agg(F.max(F.when(F.col("a.start") <= read_offset, F.col("a.end"))).alias("l"), F.min(F.when(F.col("a.rest") <= read_offset, F.col("a.start"))).alias("r"), F.max("a.size").alias("size"))
    out = g.select("name", F.greatest(F.coalesce("l", F.lit(1)), F.lit(1)).alias("trim_left"), F.least(F.coalesce("r", F.col("size") - 1), F.col("size") - 1).alias("trim_right"))
    return out.withColumn("kept", F.col("trim_right") - F.col("trim_left") >= least_left)


def best_alignments(rows: DataFrame, one: str = "name1", two: str = "name2") -> DataFrame:
    """Per (name1, name2) the row with the highest score, then lowest start, then highest stop."""
    w = Window.partitionBy(one, two).orderBy(F.desc("score"), "start", F.desc("stop"))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def alignment_listing(rows: DataFrame) -> DataFrame:
    """(name2, start, name1, score, stop, others): the best alignment of each name2 with each name1, and all other alignments of that name1 as
    'score name2 start stop' in order of name2."""
    best = best_alignments(rows)
    text = F.concat_ws(" ", "score", "name2", "start", "stop")
    others = rows.groupBy("name1").agg(F.transform(F.array_sort(F.collect_list(F.struct("name2", "start", "stop", "score", text.alias("t")))), lambda x: x["t"]).alias("all"))
    return best.join(others, "name1").select("name2", "start", "name1", "score", "stop", F.array_except("all", F.array(text)).alias("others"))


def alignment_counts(rows: DataFrame) -> DataFrame:
    """(name2, start, name1, score, stop, n_others): alignment_listing with the number of the other alignments instead of the alignments themselves.

    A listing repeats all of a name1's alignments in each of its rows, which grows as their square; here they are counted once a name1. A row's own alignment is always one of them.
    Both sides start from one exchange by pair; texts of different name2 differ, as names have no blanks.
    """
    rows = rows.repartition("name1", "name2")
    text = F.concat_ws(" ", "score", "name2", "start", "stop")
    times = rows.select("name1", "name2", text.alias("t")).distinct().groupBy("name1").agg((F.count("*") - 1).alias("n_others"))
    return best_alignments(rows).join(times, "name1").select("name2", "start", "name1", "score", "stop", "n_others")


def best_reads(matches: DataFrame) -> DataFrame:
    """(read, read_list): for each read the best scored candidates (match_length, identity, read_length), reads of all equal matches.

    A match's candidate is read1 (the longer one), or both reads if flag is set (equal length).
    """
    m = matches.where((F.col("read1") != F.col("read2")))
    score = F.struct("match_length", "identity", "read_length").alias("score")
    cand = F.when(F.col("flag") == 1, F.array("read1", "read2")).otherwise(F.array("read1"))
    rows = m.select(F.explode(F.array("read1", "read2")).alias("read"), score, cand.alias("c"))
    top = rows.withColumn("best", F.max("score").over(Window.partitionBy("read"))).where("score = best")
    return top.select("read", F.explode("c").alias("c")).groupBy("read").agg(F.array_sort(F.collect_set("c")).alias("read_list"))


def ranked_choice(best: DataFrame) -> DataFrame:
    """(read, kept): each read's one candidate, the one chosen most often over all reads, then the highest name."""
    pairs = best.select("read", F.explode("read_list").alias("c"))
    times = pairs.groupBy("c").agg(F.count("*").alias("n"))
    return pairs.join(times, "c").groupBy("read").agg(F.max(F.struct("n", "c")).alias("m")).select("read", F.col("m.c").alias("kept"))


def reduce_duplicates(matches: DataFrame, repeat: bool = False, most_rounds: int = 100) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(duplicates (read, kept), rounds): reads replaced by a better one; rounds lists (orphans, duplicates, new). With repeat, rounds go on over the reads left until nothing new.

    If most_rounds do not suffice it raises. A round ranks over all remaining matches; an orphan's replacement is itself replaced. Lineage is cut by a written table each round.
    """
    spark = matches.sparkSession
    rounds, found, left = [], None, matches
    while True:
        choice, path = written(ranked_choice(best_reads(left)), "choice")
        new = choice.where("read <> kept")
        other = choice.select(F.col("read").alias("kept"), F.col("kept").alias("next"))
        s = new.join(other, "kept").agg(F.count("*").alias("n"), F.count_if(F.col("next") != F.col("kept")).alias("o")).first()
        if not s["n"]:
            drop_table(spark, path)
            break
        rounds.append((s["o"], s["n"] - s["o"], s["n"]))
        found = new if found is None else found.unionByName(new)
        if not repeat:
            break
        gone = new.select("read")
        if len(rounds) == most_rounds:
            raise RuntimeError(f"still new duplicates after {most_rounds} rounds")
        left, _ = written(left.join(gone.withColumnRenamed("read", "read1"), "read1", "left_anti").join(gone.withColumnRenamed("read", "read2"), "read2", "left_anti"), "left")
    if found is None:
        found = spark.createDataFrame([], "read string, kept string")
    return found.select("read", "kept"), rounds
