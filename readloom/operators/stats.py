"""Read, library, scaffold and long-read statistics; joins of alignment files with reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.order import Ordered
from readloom.session import written


def quality_stats(reads: DataFrame, step: int = 50, least: int = 20, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """(keys, n_reads, n_bases, n_high, n_failed) per file and, with null keys, over all: bases of quality >= 20 and reads with fewer than `least` of them."""
    r = reads.select(*keys, F.size("qual").alias("n"), F.size(F.filter("qual", lambda q: (q >= 20) & (q != 98))).alias("high"))
    return r.rollup(*keys).agg(F.count("*").alias("n_reads"), F.sum("n").alias("n_bases"), F.sum("high").alias("n_high"), F.count_if(F.col("high") < least).alias("n_failed"))


def quality_histogram(reads: DataFrame, step: int = 50) -> DataFrame:
    """(bin, n_reads): reads by their number of bases of quality >= 20, in steps."""
    high = F.size(F.filter("qual", lambda q: (q >= 20) & (q != 98)))
    return reads.select(F.floor(high / step).alias("b")).groupBy((F.col("b") * step).alias("bin")).agg(F.count("*").alias("n_reads"))


def quality_by_position(reads: DataFrame) -> DataFrame:
    """(pos, n, mean_quality, pct30): per position the mean quality (floor) and the share of qualities >= 30; qualities 98 and 0 do not count."""
    q = reads.select(F.posexplode("qual").alias("pos", "q")).where("q not in (0, 98)")
    return q.groupBy("pos").agg(F.count("*").alias("n"), F.floor(F.avg("q")).alias("mean_quality"), F.round(100.0 * F.count_if(F.col("q") >= 30) / F.count("*"), 4).alias("pct30"))


def scaffold_runs(reads: DataFrame, key: str = "name") -> DataFrame:
    """(key, start, stop, gap): maximal runs of N by whether their quality is 0 (plain Ns) or above (gap between contigs)."""
    b = reads.select(key, F.posexplode(F.arrays_zip(F.split(F.upper("seq"), "").alias("b"), F.col("qual").alias("q"))).alias("pos", "z")).where(F.col("z.b") == "N")
    b = b.select(key, "pos", (F.col("z.q") > 0).alias("gap"))
    w = Window.partitionBy(key, "gap").orderBy("pos")
    return b.withColumn("g", F.col("pos") - F.row_number().over(w)).groupBy(key, "gap", "g").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop")).select(key, "start", "stop", "gap")


def scaffold_stats(reads: DataFrame, least_low: int = 40, key: str = "name") -> DataFrame:
    """(key, n_bases, contigs, n_runs, n_bases_n, gap_runs, gap_bases, low_quality, gc): per scaffold; low quality leaves gap Ns out, GC counts capitals only."""
    runs = scaffold_runs(reads, key).groupBy(key).agg(
        F.count_if(~F.col("gap")).alias("n_runs"), F.coalesce(F.sum(F.when(~F.col("gap"), F.col("stop") - F.col("start"))), F.lit(0)).alias("n_bases_n"),
        F.count_if("gap").alias("gap_runs"), F.coalesce(F.sum(F.when(F.col("gap"), F.col("stop") - F.col("start"))), F.lit(0)).alias("gap_bases"),
    )
    r = reads.select(key, F.length("seq").alias("n_bases"), F.size(F.filter("qual", lambda q: q < least_low)).alias("low"), (F.length("seq") - F.length(F.translate("seq", "GC", ""))).alias("gc"), F.size(F.filter(F.arrays_zip(F.split(F.upper("seq"), "").alias("b"), F.col("qual").alias("q")), lambda z: (z["b"] == "N") & (z["q"] > 0) & (z["q"] < least_low))).alias("lowgap"))
    j = r.join(runs, key, "left").fillna(0, ["n_runs", "n_bases_n", "gap_runs", "gap_bases"])
    return j.select(key, "n_bases", (F.col("gap_runs") + 1).alias("contigs"), "n_runs", "n_bases_n", "gap_runs", "gap_bases", (F.col("low") - F.col("lowgap")).alias("low_quality"), "gc")


def project_totals(reads: DataFrame, sets: DataFrame) -> DataFrame:
    """(set_id, n_reads, n_high) over lists of files (set_id, file)."""
    r = reads.select("file", F.size(F.filter("qual", lambda q: q >= 20)).alias("h")).join(sets, "file")
    return r.groupBy("set_id").agg(F.count("*").alias("n_reads"), F.sum("h").alias("n_high"))


def library_stats(reads: DataFrame, good: int = 400) -> DataFrame:
    """(library, n_reads, n_good, good_pairs, n_high) with a row of totals (null library). reads: library, base, n_high; a good pair has two good reads of a base."""
    g = reads.withColumn("good", F.col("n_high") >= good)
    pairs = g.groupBy("library", "base").agg(F.count("*").alias("n"), F.count_if("good").alias("g"), F.sum("n_high").alias("h"))
    return pairs.rollup("library").agg(F.sum("n").alias("n_reads"), F.sum("g").alias("n_good"), F.count_if(F.col("g") >= 2).alias("good_pairs"), F.sum("h").alias("n_high"))


def longest_subreads(rows: DataFrame, order: list[str], hole: str = "hole_number") -> DataFrame:
    """(hole, length): the longest of adjacent rows (in order; a new first order column starts anew) of the same hole. A null hole is alone."""
    part = order[0]
    o = Ordered(rows.select(*dict.fromkeys([*order, hole, "length"])), *order).with_neighbours(*dict.fromkeys([hole, part]))
    goes_on = F.coalesce((F.col(hole) == F.col(f"__prev_{hole}")) & F.col(part).eqNullSafe(F.col(f"__prev_{part}")), F.lit(False))
    return o.running((~goes_on).cast("int"), "__g").groupBy("__g", hole).agg(F.max("length").alias("length")).select(hole, "length")


def length_table(lengths: DataFrame, step: int = 1000, genome: int | None = None) -> DataFrame:
    """(cutoff, n_reads, n_bases, median, coverage) of reads at least as long as each cutoff 0, step, 2 * step, ...; an even number of reads has the floored mean of the middle two as median.

    Reads are counted by length first, so cutoffs meet a histogram, not reads.
    """
    h = lengths.groupBy("length").agg(F.count("*").alias("c"))
    cut = h.select("length", "c", F.explode(F.sequence(F.lit(0), F.expr(f"length div {step} * {step}"), F.lit(step))).alias("cutoff"))
    w = Window.partitionBy("cutoff").orderBy("length")
    r = cut.withColumns({"upto": F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(Window.partitionBy("cutoff"))})
    mid = lambda k: F.min(F.when(F.col("upto") >= k, F.col("length")))
    g = r.groupBy("cutoff").agg(F.sum("c").alias("n_reads"), F.sum(F.col("c") * F.col("length")).alias("n_bases"), mid(F.expr("(n + 1) div 2")).alias("a"), mid(F.expr("n div 2 + 1")).alias("b"))
    cover = F.round(F.col("n_bases") / F.lit(genome), 4) if genome else F.lit(None).cast("double")
    return g.select("cutoff", "n_reads", "n_bases", F.floor((F.col("a") + F.col("b")) / 2).alias("median"), cover.alias("coverage"))


def well_sizes(rows: DataFrame, hole: str = "hole_number", cells: int = 2**21) -> DataFrame:
    """(well_row, well_column, longest, total, passes, weight) of every well in the grid spanned by the holes; weight is the total over mean + 2 population standard deviations, at most 1.

    Empty wells have zeros. The grid is not joined: each well is followed by the empty ones up to the next of its row, in tasks of about `cells` wells. One row (the grid's size) reaches the driver.
    """
    spark = rows.sparkSession
    g, _ = written(rows.groupBy(hole).agg(F.max("length").alias("longest"), F.sum("length").alias("total"), F.max("passes").alias("passes")), "wells")
    s = g.agg((F.avg("total") + 2 * F.stddev_pop("total")).alias("norm"), F.max(F.shiftright(hole, 16)).alias("mr"), F.max(F.col(hole).bitwiseAND(F.lit(65535))).alias("mc")).first()
    n_rows, n_columns = (0, 0) if s["mr"] is None else (max(s["mr"] + 1, 0), s["mc"] + 1)
    weight = lambda total: F.round(F.least(F.lit(1.0), total / F.lit(s["norm"]).cast("double")), 6)
    values = {c: F.coalesce(c, F.lit(0)) for c in ("longest", "total", "passes")}
    wells = g.select(F.shiftright(hole, 16).cast("bigint").alias("well_row"), F.col(hole).bitwiseAND(F.lit(65535)).cast("bigint").alias("at"), *[v.alias(c) for c, v in values.items()]).where("well_row >= 0").withColumn("weight", weight(F.col("total")))
    # every row begins before its first column, so that rows without holes are filled too
    begins = spark.range(n_rows).select(F.col("id").alias("well_row"), F.lit(-1).cast("bigint").alias("at"))
    u = wells.unionByName(begins, allowMissingColumns=True).repartition(max(spark.sparkContext.defaultParallelism, -(-n_rows * n_columns // cells)), "well_row")
    u = u.withColumn("to", F.lead("at", 1, n_columns).over(Window.partitionBy("well_row").orderBy("at")))
    u = u.select("*", F.explode(F.sequence("at", F.col("to") - 1)).alias("well_column")).where("well_column >= 0")
    own, empty = F.col("well_column") == F.col("at"), {"weight": weight(F.lit(0).cast("bigint"))}
    return u.select("well_row", "well_column", *[F.when(own, F.col(c)).otherwise(empty.get(c, F.lit(0))).alias(c) for c in ("longest", "total", "passes", "weight")])


# --- alignment files and reads


def add_passes(rows: DataFrame, passes: DataFrame) -> DataFrame:
    """rows (name, ...) with n_passes by name; names without a value are left out."""
    return rows.join(passes.groupBy("name").agg(F.max("num_passes").alias("num_passes")), "name")


def add_quality(rows: DataFrame, reads: DataFrame) -> DataFrame:
    """rows (name, start, stop, seq) with the bases and qualities of the named read's range (reversed if start > stop) and whether the bases agree."""
    from readloom.functions.dna import reverse_complement

    j = rows.join(reads.select("name", F.col("seq").alias("__s"), F.col("qual").alias("__q")), "name")
    lo, hi = F.least("start", "stop"), F.greatest("start", "stop")
    s, q = F.substring(F.col("__s"), lo + 1, hi - lo), F.slice("__q", lo + 1, hi - lo)
    back = F.col("start") > F.col("stop")
    j = j.withColumns({"qual": F.when(back, F.reverse(q)).otherwise(q), "agrees": F.upper("seq") == F.upper(F.when(back, reverse_complement(s)).otherwise(s))})
    return j.drop("__s", "__q")


def without_holes(rows: DataFrame, listed: DataFrame, hole: str = "hole_number") -> DataFrame:
    return rows.join(listed.select(hole).distinct(), hole, "left_anti")


def good_passes(rows: DataFrame, least: int = 3) -> DataFrame:
    return rows.where(F.col("num_passes") >= least)


def same_hole(rows: DataFrame) -> DataFrame:
    """Alignments whose read and reference come from the same hole."""
    from readloom.functions.names import hole

    return rows.where(hole(F.col("read_name")) == hole(F.col("ref_name")))


def split_by_holes(rows: DataFrame, kept: DataFrame, chunks: int, hole: str = "hole_number") -> DataFrame:
    """rows of the kept holes with chunk 0..chunks-1: consecutive holes, the first chunks one hole larger."""
    from readloom.operators.route import even_chunks

    holes = rows.select(hole).distinct().join(kept.select(hole).distinct(), hole, "left_semi")
    return rows.join(even_chunks(holes, hole, chunks), hole)


def status_summary(reads: DataFrame, status: str = "status") -> DataFrame:
    """(status, n_reads, n_bases) by number descending, name."""
    return reads.groupBy(status).agg(F.count("*").alias("n_reads"), F.sum(F.length("seq")).alias("n_bases"))
