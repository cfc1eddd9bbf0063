"""Repeat masking and repetitiveness of reads.

The repetitive k-mers are counted first. Up to a checked number of them goes to the tasks, and reads are masked where they are; beyond it windows cross the shuffle once, as
(read number, position, packed k-mer), and only the repetitive ones come back, one list of positions a read. A mask is a column of ranges, so all that follows is per-row work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.arrow import slices
from readloom.functions.packed import Batch
from readloom.functions.reads import numbered
from readloom.operators import kmers as K
from readloom.session import written

THRESHOLDS = (*range(2, 21), *range(25, 101, 5))  # fixed values: count limits of the read histogram
RANGES = "array<struct<start:bigint,stop:bigint>>"


def _repetitive(least: int, below: int | None) -> Column:
    x = F.coalesce("cnt", F.lit(0))
    return (x >= least) if below is None else (x >= least) & (x < below)


def _counted(reads: DataFrame, counted: DataFrame | None, k: int) -> DataFrame:
    return K.key_counts(reads, k) if counted is None else K.keyed(counted.select("kmer", "cnt"), k)


def _bounds(flags: np.ndarray, row: np.ndarray, starts: np.ndarray, n: int) -> pa.Array:
    """Runs of set flags, per row, as lists of ranges."""
    edge = np.ones(len(flags) + 1, bool)
    edge[1:-1] = (flags[1:] != flags[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(edge)
    begin, end = at[:-1], at[1:]
    keep = flags[begin]
    begin, end = begin[keep], end[keep]
    offset = starts[row[begin]]
    value = pa.StructArray.from_arrays([pa.array((begin - offset).astype(np.int64)), pa.array((end - offset).astype(np.int64))], names=["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[begin], minlength=n))]).astype(np.int32)), value)


def _mask(b: Batch, at: np.ndarray, k: int, x: int) -> np.ndarray:
    """Which bases are masked, from the starts of repetitive windows."""
    total = len(b.codes)
    plain = b.codes < 4
    # maximal runs of plain bases within a row: their bounds at every base
    new = np.ones(total, bool)
    new[1:] = (plain[1:] != plain[:-1]) | (b.row[1:] != b.row[:-1])
    run = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], total)[run] if total else np.zeros(0, int)
    start = begin[run] if total else np.zeros(0, int)
    pos = np.arange(total)
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, at, 1)
    np.subtract.at(cover, np.minimum(at + k, total), 1)
    c = np.cumsum(cover[:total])
    last = stop - k
    first_slot = np.where(pos <= last, np.maximum(start, pos - (k - 1)), pos - (k - 1))
    slots = np.minimum(pos, last) - first_slot + 1
    usable = plain & (stop - start >= k)
    state = np.where(c >= x, 1, np.where(c < slots, 0, -1))
    decided = usable & (state >= 0)
    # the decided base before and after, within the run
    seen = np.maximum.accumulate(np.where(decided, pos, -1)) if total else pos
    before = np.concatenate([[-1], seen[:-1]]) if total else pos
    ahead = np.minimum.accumulate(np.where(decided, pos, total)[::-1])[::-1] if total else pos
    after = np.append(ahead[1:], total) if total else pos
    left = (before >= start) & (state[np.maximum(before, 0)] == 1) if total else np.zeros(0, bool)
    right = (after < stop) & (state[np.minimum(after, total - 1)] == 1) if total else np.zeros(0, bool)
    masked = usable & np.where(state >= 0, state == 1, left | right)
    return masked


def _masks(batches: Iterator[pa.RecordBatch], k: int, x: int) -> Iterator[pa.RecordBatch]:
    """(id, mask) from (id, seq, hits), hits being the starts of repetitive windows."""
    for t in batches:
        b = Batch(t.column(1))
        lists = t.column(2)
        owner = np.repeat(np.arange(t.num_rows), lists.value_lengths().to_numpy())
        masked = _mask(b, lists.flatten().to_numpy().astype(np.int64) + b.starts[owner], k, x)
        yield pa.RecordBatch.from_arrays([t.column(0), _bounds(masked, b.row, b.starts, t.num_rows)], names=["id", "mask"])


def _masks_of(batches: Iterator[pa.RecordBatch], keys: np.ndarray, k: int, x: int) -> Iterator[pa.RecordBatch]:
    """Rows with their mask, the repetitive k-mers being known (sorted keys)."""
    for t in slices(batches, "seq", 1_000_000):
        b = Batch(t.column(t.schema.get_field_index("seq")))
        at = np.flatnonzero(b.valid(k))
        if len(keys) and len(at):
            word = b.canonical(k)[at]
            at = at[keys[np.minimum(np.searchsorted(keys, word), len(keys) - 1)] == word]
        else:
            at = at[:0]
        yield pa.RecordBatch.from_arrays([*t.columns, _bounds(_mask(b, at, k, x), b.row, b.starts, t.num_rows)], names=[*t.schema.names, "mask"])


def masked_reads(reads: DataFrame, k: int, least: int, below: int | None = None, coverage: int = 1, counted: DataFrame | None = None, most_keys: int = 1_000_000) -> DataFrame:
    """reads with mask, ranges of masked bases. A k-mer is repetitive if it occurs at least `least` and under `below` times in counted (kmer, cnt), or in the reads
    themselves. A base is masked if at least `coverage` (at most k) repetitive k-mers cover it; where fewer do but all that cover it are repetitive, it follows the base
    on its left if that is masked, else the next decided base of its run.

    reads: seq not null, any other columns. Runs of plain bases shorter than k are never masked. least: 1 or more.
    Up to most_keys repetitive k-mers (8 bytes each) are sent to the tasks, and reads are masked where they are; beyond that windows meet their counts in a join.
    """
    x = min(coverage, k)
    keys, _ = written((K.key_counts(reads, k) if counted is None else K.keyed(counted.select("kmer", "cnt"), k)).where(_repetitive(least, below)).select("kmer"), "repetitive")
    if k <= 32 and keys.count() <= most_keys:
        found = np.sort(np.array([r[0] for r in keys.collect()], np.int64).view(np.uint64))
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reads.schema)
        return reads.mapInArrow(lambda it: _masks_of(it, found, k, x), f"{ddl}, mask {RANGES}")
    r = numbered(reads)
    hits = K.key_windows(r, k, "__id").join(keys, "kmer", "left_semi")
    lists = hits.groupBy("id").agg(F.collect_list("pos").alias("hits"))  # at most one entry a base of one read
    each = r.select(F.col("__id").alias("id"), "seq").join(lists, "id").select("id", "seq", "hits").mapInArrow(lambda it: _masks(it, k, x), f"id bigint, mask {RANGES}")
    return r.join(each, r["__id"] == each["id"], "left").withColumn("mask", F.coalesce("mask", F.array().cast(RANGES))).drop("__id", "id")


def masked_positions(masked: DataFrame, name: str = "name") -> DataFrame:
    """(name, pos): every masked base."""
    each = masked.select(name, F.explode("mask").alias("m"))
    return each.select(name, F.explode(F.sequence(F.col("m.start"), F.col("m.stop") - 1)).alias("pos"))


def masked_ranges(masked: DataFrame, name: str = "name") -> DataFrame:
    """(name, start, stop): the masked ranges (half-open)."""
    return masked.select(name, F.explode("mask").alias("m")).select(name, "m.start", "m.stop")


def _mask_size() -> Column:
    return F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, m: a + m["stop"] - m["start"])


def masked_percent(masked: DataFrame, name: str = "name") -> DataFrame:
    """(name, masked_pct) of reads with any masked base."""
    return masked.where(F.size("mask") > 0).select(name, F.round(100.0 * _mask_size() / F.length("seq"), 2).alias("masked_pct"))


def apply_mask(masked: DataFrame, how: str = "X", reverse: bool = False, name: str = "name", seq: str = "seq") -> DataFrame:
    """(name, seq) with masked bases as X ('X') or in lower case ('lower', all others upper); reverse masks what is not masked. Work per read is in proportion to its length."""
    s = F.col(seq)
    hidden = (lambda x: F.repeat(F.lit("X"), F.length(x))) if how == "X" else F.lower
    shown = (lambda x: x) if how == "X" else F.upper
    inside, outside = (shown, hidden) if reverse else (hidden, shown)
    piece = lambda a, b: F.substring(s, (a + 1).cast("int"), (b - a).cast("int"))
    ends = F.transform("mask", lambda m: m["stop"])
    at = F.concat(F.array(F.lit(0).cast("bigint")), ends)  # where the piece before each range, and the rest, begin
    before = F.transform("mask", lambda m, i: F.concat(outside(piece(F.get(at, i), m["start"])), inside(piece(m["start"], m["stop"]))))
    rest = F.element_at(at, -1)
    return masked.select(name, F.concat(F.array_join(before, ""), outside(piece(rest, F.length(s)))).alias(seq))


def _flags(t: pa.RecordBatch, b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Per base: masked, quality (columns seq, mask, qual in this order from column 1)."""
    lists = t.column(2)
    owner = np.repeat(np.arange(t.num_rows), lists.value_lengths().to_numpy())
    flat = lists.flatten()
    step = np.zeros(len(b.codes) + 1, np.int64)
    np.add.at(step, flat.field("start").to_numpy() + b.starts[owner], 1)
    np.subtract.at(step, flat.field("stop").to_numpy() + b.starts[owner], 1)
    return np.cumsum(step[:-1]) > 0, t.column(3).flatten().to_numpy()


def _anchored(batches: Iterator[pa.RecordBatch], anchors: int, quality: int) -> Iterator[pa.RecordBatch]:
    for t in batches:
        b = Batch(t.column(1))
        masked, q = _flags(t, b)
        open_ = ~masked & (b.codes < 4)
        keep = masked.copy()
        if len(open_):
            new = np.ones(len(open_), bool)
            new[1:] = (open_[1:] != open_[:-1]) | (b.row[1:] != b.row[:-1])
            at = np.flatnonzero(new)
            end = np.append(at[1:], len(open_))
            good = open_[at] & (np.add.reduceat((q >= quality) & open_, at) >= anchors)
            lo, hi = np.full(t.num_rows, len(open_)), np.full(t.num_rows, -1)
            np.minimum.at(lo, b.row[at[good]], at[good])
            np.maximum.at(hi, b.row[at[good]], end[good] - 1)
            pos = np.arange(len(open_))
            keep &= (pos < lo[b.row]) | (pos > hi[b.row])
        yield pa.RecordBatch.from_arrays([t.column(0), _bounds(keep, b.row, b.starts, t.num_rows)], names=["name", "mask"])


def anchored_mask(masked: DataFrame, anchors: int, quality: int = 20, name: str = "name") -> DataFrame:
    """(name, mask) without the bases between the first and the last unmasked ACGT stretch that holds at least `anchors` bases of the given quality.

    masked: name, seq, mask, qual (as long as seq). Reads without such a stretch keep their mask.
    """
    return masked.select(F.col(name).alias("name"), "seq", "mask", "qual").mapInArrow(lambda it: _anchored(it, anchors, quality), f"name string, mask {RANGES}").withColumnRenamed("name", name)


def _open_count(batches: Iterator[pa.RecordBatch], quality: int) -> Iterator[pa.RecordBatch]:
    for t in batches:
        b = Batch(t.column(1))
        masked, q = _flags(t, b)
        n = np.bincount(b.row[~masked & (b.codes < 4) & (q >= quality)], minlength=t.num_rows)
        yield pa.RecordBatch.from_arrays([t.column(0), pa.array(n.astype(np.int64))], names=["name", "n"])


def unique_high_quality(masked: DataFrame, quality: int = 20, name: str = "name") -> DataFrame:
    """(name, n): bases of the given quality that are plain and not masked; reads without any are left out. masked: name, seq, mask, qual (as long as seq)."""
    n = masked.select(F.col(name).alias("name"), "seq", "mask", "qual").mapInArrow(lambda it: _open_count(it, quality), "name string, n bigint")
    return n.where("n > 0").withColumnRenamed("name", name)


def _met(reads: DataFrame, counted: DataFrame | None, k: int, how: str = "inner") -> tuple[DataFrame, DataFrame]:
    """Numbered reads, and their distinct k-mers (id, kmer, n, pos) with the counts (cnt)."""
    r = numbered(reads)
    return r, K.read_kmers(r, k, "__id").join(_counted(r, counted, k), "kmer", how)


def _by_name(r: DataFrame, g: DataFrame, name: str) -> DataFrame:
    return g.join(r.select(F.col("__id").alias("id"), name), "id").drop("id")


def kmer_totals(reads: DataFrame, k: int, counted: DataFrame | None = None, name: str = "name") -> DataFrame:
    """(name, top, total): greatest and summed count of the k-mers of each read's windows; reads without windows are left out."""
    r, met = _met(reads, counted, k, "left")
    return _by_name(r, met.groupBy("id").agg(F.max("cnt").alias("top"), F.sum(F.col("cnt") * F.col("n")).alias("total")), name)


def repetitiveness(reads: DataFrame, k: int, least: int, below: int | None = None, counted: DataFrame | None = None, name: str = "name") -> DataFrame:
    """(name, kmers, r_kmers, ur_kmers, r_pct, ur_pct): windows, repetitive windows, distinct repetitive k-mers (canonical)."""
    r, met = _met(reads, counted, k, "left")
    rep = _repetitive(least, below)
    zero = F.lit(0).cast("bigint")
    g = met.groupBy("id").agg(F.sum("n").alias("kmers"), F.coalesce(F.sum(F.when(rep, F.col("n"))), zero).alias("r_kmers"), F.count_if(rep).alias("ur_kmers"))
    return _by_name(r, g, name).select(name, "kmers", "r_kmers", "ur_kmers", F.round(100.0 * F.col("r_kmers") / F.col("kmers"), 4).alias("r_pct"), F.round(F.when(F.col("r_kmers") > 0, 100.0 * F.col("ur_kmers") / F.col("r_kmers")), 4).alias("ur_pct"))


def read_histogram(reads: DataFrame, k: int, counted: DataFrame | None = None) -> DataFrame:
    """(threshold, bin, n_reads, n_reads_distinct): reads by twentieths of their k-mers that reach each threshold, and of distinct ones among those."""
    _, met = _met(reads, counted, k)
    limits = F.array(*[F.lit(t) for t in THRESHOLDS])
    # k-mers of a read by the number of thresholds they reach, then summed from the highest down: some 36 numbers a read
    level = F.size(F.filter(limits, lambda t: t <= F.col("cnt")))
    one = met.groupBy("id", level.alias("level")).agg(F.sum("n").alias("r"), F.count("*").alias("u"))
    per = one.groupBy("id").agg(F.sum("r").alias("kmers"), F.collect_list(F.struct("level", "r", "u")).alias("by"))
    total = lambda c, i: F.aggregate("by", F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["level"] > i, x[c]).otherwise(0))
    rows = per.select("kmers", F.posexplode(limits).alias("i", "threshold"), "by").select("kmers", "threshold", total("r", F.col("i")).alias("r"), total("u", F.col("i")).alias("u")).where("r > 0")
    bins = rows.select("threshold", F.posexplode(F.array(F.expr("(20 * r - 1) div kmers"), F.expr("(20 * u - 1) div r"))).alias("t", "bin"))
    return bins.groupBy("threshold", "bin").agg(F.count_if(F.col("t") == 0).alias("n_reads"), F.count_if(F.col("t") == 1).alias("n_reads_distinct"))
