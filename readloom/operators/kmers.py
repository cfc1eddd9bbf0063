"""k-mers: windows, counts, histograms, several read lists, combination of counts.

Windows are k consecutive bases A C G T (either case); any other character breaks them. Keys are
canonical (the lower of the k-mer and its reverse complement). Counts of k <= 32 run on packed words (one 8-byte key a k-mer in
the shuffle, combined per Arrow batch first); longer k-mers and positions are plain Catalyst expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.arrow import gathered
from readloom.functions.dna import canonical, gc_count, runs
from readloom.functions.packed import Batch, first_of_runs, letters


def windows(reads: DataFrame, k: int, keep: list[str], seq: str = "seq", both: bool = True) -> DataFrame:
    """keep columns, pos (0-based start) and kmer (canonical if both strands are one) of every valid window."""
    s = F.upper(F.col(seq))
    at = reads.where(F.length(seq) >= k).select(*keep, s.alias("__s"), F.explode(F.sequence(F.lit(1), F.length(seq) - k + 1)).alias("__p"))
    cut = at.select(*keep, (F.col("__p") - 1).alias("pos"), F.substring(F.col("__s"), F.col("__p"), F.lit(k)).alias("kmer")).where(F.col("kmer").rlike(f"^[ACGT]{{{k}}}$"))
    return cut.withColumn("kmer", canonical(F.col("kmer"))) if both else cut


def _packed_counts(batches: Iterator[pa.RecordBatch], k: int, tags: int) -> Iterator[pa.RecordBatch]:
    for t in gathered(batches, "seq", 1_000_000):
        b = Batch(t.column("seq"))
        ok = b.valid(k)
        word, row = b.canonical(k)[ok], b.row[: len(ok)][ok]
        if not len(word):
            continue
        tag = t.column("tag").to_numpy()[row].astype(np.int64) if tags else np.zeros(len(word), np.int64)
        order = np.lexsort((word, tag)) if tags else np.argsort(word)
        word, tag = word[order], tag[order]
        starts = first_of_runs(tag, word)
        n = np.diff(np.append(starts, len(word)))
        yield pa.RecordBatch.from_arrays([pa.array(tag[starts]), pa.array(word[starts].view(np.int64)), pa.array(n)], names=["tag", "word", "cnt"])


def _packed_windows(batches: Iterator[pa.RecordBatch], k: int, both: bool) -> Iterator[pa.RecordBatch]:
    for t in gathered(batches, "seq", 1_000_000):
        b = Batch(t.column("seq"))
        at = np.flatnonzero(b.valid(k))
        row, word = b.row[at], (b.canonical(k) if both else b.packed(k))[at]
        yield pa.RecordBatch.from_arrays([pa.array(t.column("id").to_numpy()[row]), pa.array((at - b.starts[row]).astype(np.int32)), pa.array(word.view(np.int64))], names=["id", "pos", "kmer"])


def _packed_kmers(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for t in gathered(batches, "seq", 1_000_000):
        b = Batch(t.column("seq"))
        at = np.flatnonzero(b.valid(k))
        row, word = b.row[at], b.canonical(k)[at]
        order = np.lexsort((word, row))  # stable: positions stay in order
        row, word, at = row[order], word[order], at[order]
        first = first_of_runs(row, word)
        n = np.diff(np.append(first, len(row)))
        row, word, at = row[first], word[first], at[first]
        yield pa.RecordBatch.from_arrays([pa.array(t.column("id").to_numpy()[row]), pa.array(word.view(np.int64)), pa.array(n.astype(np.int64)), pa.array((at - b.starts[row]).astype(np.int32))], names=["id", "kmer", "n", "pos"])


def key_windows(reads: DataFrame, k: int, id: str, seq: str = "seq", both: bool = True) -> DataFrame:
    """(id, pos, kmer) of every valid window; id is a bigint column. kmer is a key: the packed word for k <= 32, else the text (see spell)."""
    src = reads.select(F.col(id).cast("bigint").alias("id"), F.col(seq).alias("seq"))
    if k <= 32:
        return src.mapInArrow(lambda it: _packed_windows(it, k, both), "id bigint, pos int, kmer bigint")
    return windows(src, k, ["id"], both=both)


def read_kmers(reads: DataFrame, k: int, id: str, seq: str = "seq") -> DataFrame:
    """(id, kmer, n, pos): each distinct canonical k-mer (a key) of every row with its multiplicity and first position; id is a bigint column, one row an id."""
    src = reads.select(F.col(id).cast("bigint").alias("id"), F.col(seq).alias("seq"))
    if k <= 32:
        return src.mapInArrow(lambda it: _packed_kmers(it, k), "id bigint, kmer bigint, n bigint, pos int")
    return windows(src, k, ["id"]).groupBy("id", "kmer").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))


def key_counts(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, cnt) with kmer as a key."""
    src = reads.select(F.lit(0).cast("bigint").alias("tag"), F.col(seq).alias("seq"))
    if k <= 32:
        return src.mapInArrow(lambda it: _packed_counts(it, k, False), "tag bigint, word bigint, cnt bigint").groupBy(F.col("word").alias("kmer")).agg(F.sum("cnt").alias("cnt"))
    return windows(src, k, []).groupBy("kmer").agg(F.count("*").alias("cnt"))


def _with_column(batches: Iterator[pa.RecordBatch], i: int, f) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:i], f(b.column(i)), *b.columns[i + 1 :]], names=b.schema.names)


def spell(df: DataFrame, k: int, column: str = "kmer") -> DataFrame:
    """df with the keys of a column as text."""
    if k > 32:
        return df
    i = df.columns.index(column)
    ddl = ", ".join(f"`{f.name}` {'string' if f.name == column else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(lambda it: _with_column(it, i, lambda c: letters(c.to_numpy().view(np.uint64), k)), ddl)


def keyed(df: DataFrame, k: int, column: str = "kmer") -> DataFrame:
    """df with the k-mer text of a column as keys; rows without k plain bases there are left out."""
    if k > 32:
        return df
    i = df.columns.index(column)
    ddl = ", ".join(f"`{f.name}` {'bigint' if f.name == column else f.dataType.simpleString()}" for f in df.schema)

    def pack(c: pa.Array) -> pa.Array:
        b = Batch(c)
        return pa.array(b.packed(k)[b.starts].view(np.int64)) if len(c) else pa.array([], pa.int64())

    return df.where(F.col(column).rlike(f"^[ACGTacgt]{{{k}}}$")).mapInArrow(lambda it: _with_column(it, i, pack), ddl)


def counts(reads: DataFrame, k: int, tag: Column | None = None, seq: str = "seq", keys: bool = False) -> DataFrame:
    """(kmer, cnt), or (tag, kmer, cnt) with an integer tag per read: exact counts of canonical k-mers, a palindrome once an occurrence. keys: kmer as keys, to be spelled later."""
    tagged = tag is not None
    if k > 32:
        w = windows(reads.withColumn("__tag", tag if tagged else F.lit(0)), k, ["__tag"], seq).groupBy(F.col("__tag").cast("bigint").alias("tag"), "kmer").agg(F.count("*").alias("cnt"))
    else:
        src = reads.select((tag.cast("bigint") if tagged else F.lit(0).cast("bigint")).alias("tag"), F.col(seq).alias("seq")).where("tag is not null")
        part = src.mapInArrow(lambda it: _packed_counts(it, k, tagged), "tag bigint, word bigint, cnt bigint")
        w = part.groupBy("tag", F.col("word").alias("kmer")).agg(F.sum("cnt").alias("cnt"))
        w = w if keys else spell(w, k)
    return w if tagged else w.drop("tag")


def reference_counts(reads: DataFrame, k: int, ref: str) -> DataFrame:
    """(ref, kmer, cnt) of a text column that names references (as many as there are names); kmer is a key. Names travel as numbers."""
    from readloom.session import written

    names, _ = written(reads.select(F.col(ref).alias("ref")).where("ref is not null").distinct().withColumn("__n", F.monotonically_increasing_id()), "references")
    src = reads.select(F.col(ref).alias("ref"), "seq").join(names, "ref").select(F.col("__n").alias("tag"), "seq")
    part = src.mapInArrow(lambda it: _packed_counts(it, k, True), "tag bigint, word bigint, cnt bigint") if k <= 32 else windows(src, k, ["tag"]).select("tag", F.col("kmer").alias("word"), F.lit(1).cast("bigint").alias("cnt"))
    return part.groupBy("tag", F.col("word").alias("kmer")).agg(F.sum("cnt").alias("cnt")).join(names, F.col("tag") == F.col("__n")).select("ref", "kmer", "cnt")


def merge_counts(*tables: DataFrame) -> DataFrame:
    """Sum of saved counts."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


def histogram(counted: DataFrame, cnt: str = "cnt", gc: bool = False) -> DataFrame:
    """(freq, n, pct, cum_pct[, gc_pct]): how many k-mers occur freq times; shares are of occurrences of k-mers that occur more than once.

    The last step orders as many rows as there are different counts.
    """
    aggs = [F.count("*").alias("n")] + ([(100.0 * F.sum(gc_count(F.col("kmer"))) / F.sum(F.length("kmer"))).alias("gc_pct")] if gc else [])
    h = counted.groupBy(F.col(cnt).alias("freq")).agg(*aggs)
    part = F.when(F.col("freq") > 1, F.col("freq") * F.col("n"))
    everything = Window.partitionBy()
    total = F.sum(part).over(everything)
    running = F.sum(part).over(Window.orderBy("freq").rowsBetween(Window.unboundedPreceding, 0))
    return h.select("freq", "n", F.round(100.0 * part / total, 4).alias("pct"), F.round(F.when(F.col("freq") > 1, 100.0 * running / total), 4).alias("cum_pct"), *([F.round("gc_pct", 4).alias("gc_pct")] if gc else []))


def listing(counted: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """(kmer, cnt) in both orientations (a palindrome once), counts within [least, most]."""
    kept = counted.where((F.col("cnt") >= least) & (F.lit(True) if most is None else F.col("cnt") <= most))
    rc = F.reverse(F.translate("kmer", "ACGT", "TGCA"))
    return kept.select(F.explode(F.array_distinct(F.array("kmer", rc))).alias("kmer"), "cnt")


def list_counts(reads: DataFrame, k: int, lists: DataFrame, first_only: bool) -> DataFrame:
    """(kmer, list_id, cnt): a read in lists counts for those lists only (the first one, or all), any other read for list 0.

    lists: (list_id >= 1, name).
    """
    picked = lists.where("name is not null").groupBy("name").agg(F.min("list_id").alias("__first"), F.collect_set("list_id").alias("__all"))
    ids = F.array("__first") if first_only else F.col("__all")
    tagged = reads.join(picked, "name", "left").select("seq", F.explode(F.when(F.col("__first").isNull(), F.array(F.lit(0))).otherwise(ids)).alias("list_id"))
    return counts(tagged, k, F.col("list_id")).withColumnRenamed("tag", "list_id")


def _wide(tagged: DataFrame, n_lists: int) -> DataFrame:
    """(kmer, x array): x[0] the main count, x[i] the count of list i."""
    x = [F.sum(F.when(F.col("list_id") == i, F.col("cnt")).otherwise(0)) for i in range(n_lists + 1)]
    return tagged.groupBy("kmer").agg(F.array(*x).alias("x"))


def subtractive_histogram(tagged: DataFrame, n_lists: int) -> DataFrame:
    """(list_id, freq, n): occurrences that remain once the lists up to list_id are taken away, by the total count of their k-mer.

    k-mers found in list 1 alone are left out.
    """
    x = F.col("x")
    total = F.aggregate(x, F.lit(0).cast("bigint"), lambda a, b: a + b)
    rest = [F.struct(F.lit(i).alias("list_id"), (total - sum((x[j] for j in range(1, i + 1)), F.lit(0))).alias("m")) for i in range(1, n_lists + 1)]
    rows = _wide(tagged, n_lists).where(total != x[1]).select(total.alias("freq"), F.explode(F.array(*rest)).alias("l"))
    return rows.groupBy("l.list_id", "freq").agg(F.sum("l.m").alias("n"))


def comparative_histogram(tagged: DataFrame, n_lists: int) -> DataFrame:
    """(list_id, freq, n): for each list the sum of its counts by the main count of the k-mers it holds."""
    rows = _wide(tagged, n_lists).select(F.col("x")[0].alias("freq"), F.posexplode("x").alias("list_id", "m")).where("m <> 0 and list_id > 0")
    return rows.groupBy("list_id", "freq").agg(F.sum("m").alias("n"))


def plain_ranges(reads: DataFrame, k: int, keep: list[str], seq: str = "seq") -> DataFrame:
    """keep columns, start, stop of maximal ACGT runs of at least k bases."""
    return reads.select(*keep, F.explode(runs(F.col(seq), "[ACGTacgt]")).alias("r")).select(*keep, "r.start", "r.stop").where(F.col("stop") - F.col("start") >= k)


def windowed_unique(reads: DataFrame, k: int, width: int, most: int) -> DataFrame:
    """(kmer, cnt) of k-mers all of whose occurrences lie in one ACGT range, within `width` window positions, and number at most `most`.

    reads: name unique. A range is named by its read and start.
    """
    r = plain_ranges(reads, k, ["name", "seq"])
    w = windows(r.select("name", "start", F.expr("substring(seq, start + 1, stop - start)").alias("seq")), k, ["name", "start"])
    g = w.groupBy("kmer").agg(F.count("*").alias("cnt"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min(F.struct("name", "start")).alias("a"), F.max(F.struct("name", "start")).alias("b"))
    return g.where((F.col("a") == F.col("b")) & (F.col("hi") - F.col("lo") < width) & (F.col("cnt") <= most)).select("kmer", "cnt")


def homopolymer_windows(reads: DataFrame, k: int, most: int = 16, seq: str = "seq") -> DataFrame:
    """(kmer, base, run, cnt): k bases that end where a run of one base begins, that base and the run's length (capped at `most`), on either strand.

    Runs that touch the end of the read (its start, on the other strand) are ignored: their length is not known.
    """
    u = F.upper(F.col(seq))
    plain = reads.select(u.alias("r"), F.posexplode(F.regexp_extract_all(u, F.lit("[ACGT]+"), F.lit(0))).alias("i", "s"), F.size(F.regexp_extract_all(u, F.lit("[ACGT]+"), F.lit(0))).alias("m"))
    ahead = F.struct(F.col("s"), ((F.col("i") == F.col("m") - 1) & F.col("r").rlike("[ACGT]$")).alias("cut"))
    back = F.struct(F.reverse(F.translate("s", "ACGT", "TGCA")).alias("s"), ((F.col("i") == 0) & F.col("r").rlike("^[ACGT]")).alias("cut"))
    both = plain.select(F.explode(F.array(ahead, back)).alias("x")).select("x.s", "x.cut")
    hops = F.split(F.regexp_replace("s", r"(.)(?!\1)", "$1 "), " ")
    pieces = both.select("s", "cut", F.filter(hops, lambda x: x != "").alias("p"))
    starts = F.expr("transform(p, (x, i) -> aggregate(slice(p, 1, i), 0, (a, y) -> a + length(y)))")
    rows = pieces.select("s", "cut", F.size("p").alias("m"), F.posexplode(F.arrays_zip(F.col("p").alias("piece"), starts.alias("at"))).alias("i", "z"))
    rows = rows.where((F.col("i") < F.col("m") - F.col("cut").cast("int")) & (F.col("z.at") >= k))
    return rows.select(F.substring(F.col("s"), F.col("z.at") - k + 1, F.lit(k)).alias("kmer"), F.substring("z.piece", 1, 1).alias("base"), F.least(F.length("z.piece"), F.lit(most)).alias("run")).groupBy("kmer", "base", "run").agg(F.count("*").alias("cnt"))


def homopolymer_histogram(counted: DataFrame) -> DataFrame:
    """(run, n, pct): occurrences by run length."""
    h = counted.groupBy("run").agg(F.sum("cnt").alias("n"))
    return h.select("run", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("pct"))


def homopolymer_listing(counted: DataFrame) -> DataFrame:
    """(kmer, base, run, pct): share of each run length within a k-mer and its following base."""
    part = F.sum("cnt").over(Window.partitionBy("kmer", "base"))
    return counted.select("kmer", "base", "run", F.round(100.0 * F.col("cnt") / part, 4).alias("pct"))


def postings(reads: DataFrame, k: int, read_id: str = "read_id") -> DataFrame:
    """(kmer, read_id, n): reads of each k-mer with multiplicity; read_id is a bigint column, a read may have several rows."""
    each = read_kmers(reads.where(F.col(read_id).isNotNull()), k, read_id)
    return spell(each.groupBy("kmer", F.col("id").alias("read_id")).agg(F.sum("n").alias("n")), k)


def postings_histogram(posted: DataFrame) -> DataFrame:
    """(size, n_kmers): how many k-mers have so many occurrences in the index."""
    return posted.groupBy("kmer").agg(F.sum("n").alias("size")).groupBy("size").agg(F.count("*").alias("n_kmers"))


# --- sets of k-mer counts by reference


def combine_references(counted: DataFrame, least: int, most: int) -> DataFrame:
    """(kmer, n_refs, invalid) from (ref, kmer, cnt): references with least <= cnt <= most, capped at 254; a count above most makes the k-mer invalid for good."""
    g = counted.groupBy("kmer").agg(F.count_if(F.col("cnt").between(least, most)).alias("m"), F.max(F.col("cnt") > most).alias("invalid"), F.max("cnt").alias("top"))
    return g.where(F.col("top") >= least).select("kmer", F.when(F.col("invalid"), F.lit(0)).otherwise(F.least(F.lit(254), F.col("m"))).cast("bigint").alias("n_refs"), "invalid")


def combined_histogram(combined: DataFrame) -> DataFrame:
    """(n_refs, invalid, n, pct) of combined references."""
    h = combined.groupBy("n_refs", "invalid").agg(F.count("*").alias("n"))
    return h.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def screen_by_library(combined: DataFrame, library: DataFrame, least: int, most: int, keep_library: bool = False) -> DataFrame:
    """(kmer, value, invalid): combined reference k-mers screened by their count in a library (only k-mers already present are counted).

    Default: the reference value stays, k-mers the library lacks are dropped, counts out of [least, most] make invalid.
    keep_library: the library's count is the value, out of range (0 as well) is invalid.
    """
    j = combined.join(library.select("kmer", F.col("cnt").alias("lib")), "kmer", "left").withColumn("lib", F.coalesce("lib", F.lit(0)))
    bad = F.col("invalid") | ~F.col("lib").between(least, most)
    if keep_library:
        return j.select("kmer", F.when(bad, F.lit(0)).otherwise(F.col("lib")).cast("bigint").alias("value"), bad.alias("invalid"))
    return j.where("lib > 0").select("kmer", F.when(bad, F.lit(0)).otherwise(F.col("n_refs")).cast("bigint").alias("value"), bad.alias("invalid"))


def prune(counted: DataFrame, least: int, most: int) -> DataFrame:
    """k-mers with a count within [least, most]."""
    return counted.where(F.col("cnt").between(least, most))


def targets_in_few_references(target: DataFrame, combined: DataFrame, most_refs: int) -> DataFrame:
    """(kmer, n_refs) of a target's k-mers that are valid and in at most most_refs references."""
    return target.select("kmer").join(combined.where(~F.col("invalid") & F.col("n_refs").between(1, most_refs)).select("kmer", "n_refs"), "kmer")


def drop_shared(counted: DataFrame, most_refs: int) -> DataFrame:
    """(ref, kmer, cnt) without k-mers held by more than most_refs references; counted has one row a reference and k-mer."""
    wide = counted.groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") > most_refs).select("kmer")
    return counted.join(wide, "kmer", "left_anti").select("ref", "kmer", "cnt")


def presence_counts(counted: DataFrame) -> DataFrame:
    """(kmer, n_refs): in how many references each k-mer is; counted has one row a reference and k-mer."""
    return counted.groupBy("kmer").agg(F.count("*").alias("n_refs"))


def shared_identity(counted: DataFrame, least: int = 1, most_refs: int | None = None, keep_denominator: bool = False) -> DataFrame:
    """(ref_a, ref_b, shared, identity): |A and B| / |A| of all ordered pairs of references.

    counted: (ref, kmer, cnt), one row a reference and k-mer; counts under `least` are ignored. most_refs drops k-mers in more references; keep_denominator divides by the
    set size before that. Equal lists of references are counted before they are paired, so pairs are made of lists (as long as there are references), not of k-mers.
    """
    base = counted.where(F.col("cnt") >= least).select("ref", "kmer")
    every = base.groupBy("kmer").agg(F.array_sort(F.collect_list("ref")).alias("r")).groupBy("r").agg(F.count("*").alias("n"))
    used = every if most_refs is None else every.where(F.size("r") <= most_refs)
    sizes = (every if keep_denominator else used).select(F.explode("r").alias("ref_a"), "n").groupBy("ref_a").agg(F.sum("n").alias("size"))
    pairs = used.select(F.explode("r").alias("ref_a"), "r", "n").select("ref_a", F.explode("r").alias("ref_b"), "n").where("ref_a <> ref_b").groupBy("ref_a", "ref_b").agg(F.sum("n").alias("shared"))
    return pairs.join(sizes, "ref_a").select("ref_a", "ref_b", "shared", F.round(F.col("shared") / F.col("size"), 6).alias("identity"))


def presence_string(counted: DataFrame, target: str, refs: list[str]) -> DataFrame:
    """(kmer, presence): for each k-mer of the target its count in each reference, concatenated in the order given."""
    value = [F.max(F.when(F.col("ref") == r, F.col("cnt"))) for r in refs]
    g = counted.groupBy("kmer").agg(F.max(F.col("ref") == target).alias("in_target"), F.concat(*[F.coalesce(v, F.lit(0)).cast("string") for v in value]).alias("presence"))
    return g.where("in_target").select("kmer", "presence")
