"""Problem 4: long exact spans shared between records, by level-wise doubling.

The first level looks at windows of 32 bases (one 64-bit word; half the wanted length if that is under 64). Of each window of the next
length only the sub-window with the lowest hash stands for it: equal windows choose the same one, so a
window can be repeated only if its representative is. Representatives that occur in one record alone are
dropped. Then, level by level, windows of up to twice the length are built around what is repeated and counted, until the wanted
length is reached or no candidates survive. A window's key is exact: two words of bases at the second level, from then on the names
of its two (overlapping, at the last level) halves, a name being the number of a repeated window of the level before. What
survives is joined to spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.arrow import gathered
from readloom.functions.packed import Batch, first_of_runs, mix
from readloom.functions.reads import distinct_sequences, one_per_read
from readloom.session import drop_table, written


def _representatives(b: Batch, half: int, full: int) -> tuple[np.ndarray, np.ndarray]:
    """Per start of a valid full-length window: is it valid, and the lowest hash of its half-length windows."""
    ok = b.valid(full)
    if not len(ok):
        return ok, np.zeros(0, np.uint64)
    low, span, want = mix(b.packed(half)), 1, full - half + 1
    out, done = None, 0
    while True:  # the minimum over `want` neighbours, again by doubling
        if want & span:
            out, done = (low, span) if out is None else (np.minimum(out[: len(low) - done], low[done:][: len(out)]), done + span)
        if done == want:
            return ok, out[: len(ok)]
        low = np.minimum(low[:-span], low[span:])
        span *= 2


def _level_one(batches: Iterator[pa.RecordBatch], half: int, full: int) -> Iterator[pa.RecordBatch]:
    for t in gathered(batches, "seq", 1_000_000):
        b = Batch(t.column("seq"))
        ok, rep = _representatives(b, half, full)
        row, rep = b.row[: len(ok)][ok], rep[ok]
        order = np.lexsort((rep, row))
        row, rep = row[order], rep[order]
        first = first_of_runs(row, rep)
        row, rep = row[first], rep[first]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rep.view(np.int64)), pa.array(t.column("seq_id").to_numpy()[row]), pa.array(t.column("weight").to_numpy()[row])], names=["rep", "seq_id", "weight"]
        )


def _level_two(batches: Iterator[pa.RecordBatch], half: int, full: int) -> Iterator[pa.RecordBatch]:
    for t in gathered(batches, "seq", 1_000_000):
        b = Batch(t.column("seq"))
        ok, rep = _representatives(b, half, full)
        if not len(ok):
            continue
        lists = t.column("reps").combine_chunks()
        keep = lists.flatten().to_numpy().view(np.uint64)
        owner = np.repeat(np.arange(t.num_rows), lists.value_lengths().to_numpy())
        at = np.flatnonzero(ok)
        row, want = b.row[at], rep[at]
        # is (row, rep) among the kept (owner, keep)? rows and hashes are folded into one word, checked exactly after the search
        fold = lambda r, x: mix(x) ^ mix(r.astype(np.uint64), 9)
        keys = fold(owner, keep)
        order = np.argsort(keys)
        keys = keys[order]
        if not len(keys):
            continue
        found = np.minimum(np.searchsorted(keys, fold(row, want)), len(keys) - 1)
        hit = (owner[order][found] == row) & (keep[order][found] == want)
        at, row = at[hit], row[hit]
        word = b.packed(half)
        hi, lo = word[at], word[at + full - half]
        order = np.lexsort((lo, hi, row))
        first = np.zeros(len(at), bool)
        first[order[first_of_runs(row[order], hi[order], lo[order])]] = True
        weight = t.column("weight").to_numpy()[row]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(hi.view(np.int64)),
                pa.array(lo.view(np.int64)),
                pa.array(t.column("seq_id").to_numpy()[row]),
                pa.array((at - b.starts[row]).astype(np.int64)),
                pa.array(np.where(first, weight, 0)),
                pa.array(weight),
            ],
            names=["hi", "lo", "seq_id", "pos", "adds", "weight"],
        )


def _pairs(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[pa.RecordBatch]:
    """Windows made of the named windows at pos and pos + shift of one record."""
    for b in batches:
        if not b.num_rows:
            continue
        lists = b.column(2)
        lengths = lists.value_lengths().to_numpy()
        flat = lists.flatten()
        row = np.repeat(np.arange(b.num_rows), lengths)
        pos, name = flat.field("pos").to_numpy().astype(np.int64), flat.field("name").to_numpy()
        order = np.lexsort((pos, row))
        row, pos, name = row[order], pos[order], name[order]
        span = int(pos.max(initial=0)) + shift + 1  # (row, pos) in one word
        key = row * span + pos
        at = np.searchsorted(key, key + shift)
        hit = np.flatnonzero(key[np.minimum(at, len(key) - 1)] == key + shift)
        row, pos, a, z = row[hit], pos[hit], name[hit], name[at[hit]]
        order = np.lexsort((z, a, row))
        first = np.zeros(len(hit), bool)
        first[order[first_of_runs(row[order], a[order], z[order])]] = True
        weight = b.column(1).to_numpy()[row]
        yield pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(z), pa.array(b.column(0).to_numpy()[row]), pa.array(pos), pa.array(np.where(first, weight, 0)), pa.array(weight)], names=["hi", "lo", "seq_id", "pos", "adds", "weight"]
        )


WINDOWS = "hi bigint, lo bigint, seq_id bigint, pos bigint, adds bigint, weight bigint"


def shared_windows(distinct: DataFrame, length: int) -> DataFrame:
    """(seq_id, pos): starts of the windows of `length` >= 2 bases that some other record holds too.

    distinct: (seq_id, seq, weight), weight being the number of records with this very sequence.
    """
    full = min(length, 64)
    half = (full + 1) // 2 if full < 64 else 32
    one = distinct.mapInArrow(lambda it: _level_one(it, half, full), "rep bigint, seq_id bigint, weight bigint")
    repeated = one.groupBy("rep").agg(F.sum("weight").alias("w")).where("w > 1").select("rep")
    candidates = one.join(repeated, "rep").groupBy("seq_id").agg(F.collect_list("rep").alias("reps"))  # as long as the sequence at most
    windows = distinct.join(candidates, "seq_id").select("seq_id", "seq", "weight", "reps").mapInArrow(lambda it: _level_two(it, half, full), WINDOWS)
    windows, path = written(windows, "windows")
    while True:
        twice = windows.groupBy("hi", "lo").agg(F.sum("adds").alias("w")).where("w > 1").select("hi", "lo")
        if full == length:
            return windows.where("weight > 1").select("seq_id", "pos").unionByName(windows.where("weight = 1").join(twice, ["hi", "lo"]).select("seq_id", "pos"))
        twice, names_path = written(twice.withColumn("name", F.monotonically_increasing_id()), "names")  # written once, so a name stays what it is
        if twice.isEmpty():
            return twice.select(F.lit(0).cast("bigint").alias("seq_id"), F.lit(0).cast("bigint").alias("pos"))
        size, full = full, min(2 * full, length)
        shift = full - size
        named = windows.join(twice, ["hi", "lo"]).groupBy("seq_id").agg(F.max("weight").alias("weight"), F.collect_list(F.struct("pos", "name")).alias("at"))  # as long as the sequence at most
        following, following_path = written(named.mapInArrow(lambda it, shift=shift: _pairs(it, shift), WINDOWS), "windows")
        for p in (path, names_path):
            drop_table(distinct.sparkSession, p)
        windows, path = following, following_path


def merge_spans(windows: DataFrame, length: int) -> DataFrame:
    """(seq_id, span_start, span_stop): longest runs of bases covered by windows (half-open)."""
    pos = F.array_sort(F.collect_set("pos"))
    per = windows.groupBy("seq_id").agg(pos.alias("pos"))  # at most one entry per base of one sequence
    starts = F.expr(f"filter(pos, (p, i) -> i = 0 or p > pos[i - 1] + {length})")
    stops = F.expr(f"transform(filter(pos, (p, i) -> i = size(pos) - 1 or pos[i + 1] > p + {length}), p -> p + {length})")
    return per.select("seq_id", F.explode(F.arrays_zip(starts.alias("span_start"), stops.alias("span_stop"))).alias("s")).select("seq_id", "s.span_start", "s.span_stop")


def shared_spans(reads: DataFrame, length: int = 64) -> DataFrame:
    """(read_id, read_name, read_length, span_start, span_stop): runs of bases lying in a stretch of >= length plain bases that
    occurs, in the same direction, in another read.

    reads: rows with read_id, name, seq (extra columns are ignored); rows sent again count once. Null, empty and short
    sequences share nothing. A read that repeats a stretch only within itself shares nothing. length: 2 or more, else ValueError.
    """
    if length < 2:
        raise ValueError(f"length {length} is under 2")
    reads = one_per_read(reads).where(F.length("seq") >= length)
    reads = reads.select("read_id", "name", F.upper("seq").alias("seq"))
    distinct, _ = written(distinct_sequences(reads).withColumns({"h1": F.xxhash64("seq"), "h2": F.xxhash64(F.lit(1), "seq")}), "distinct")
    spans = merge_spans(shared_windows(distinct.select("seq_id", "seq", "weight"), length), length)
    named = distinct.select("seq_id", "h1", "h2").join(spans, "seq_id")
    keys = reads.select("read_id", F.col("name").alias("read_name"), F.length("seq").alias("read_length"), F.xxhash64("seq").alias("h1"), F.xxhash64(F.lit(1), "seq").alias("h2"))
    return keys.join(named, ["h1", "h2"]).select("read_id", "read_name", "read_length", "span_start", "span_stop")


def shared_amounts(reads: DataFrame, length: int = 64) -> DataFrame:
    """(read_id, read_name, read_length, shared_bases, shared_part): how much of every read lies in spans shared with other reads.

    One row a read with a sequence that is not null or empty, also if nothing of it is shared; the spans are those of shared_spans.
    """
    spans = shared_spans(reads, length).groupBy("read_id").agg(F.sum(F.col("span_stop") - F.col("span_start")).alias("shared_bases"))
    every = one_per_read(reads).where(F.length("seq") > 0).select("read_id", F.col("name").alias("read_name"), F.length("seq").cast("bigint").alias("read_length"))
    shared = F.coalesce("shared_bases", F.lit(0).cast("bigint"))
    return every.join(spans, "read_id", "left").select("read_id", "read_name", "read_length", shared.alias("shared_bases"), F.round(shared / F.col("read_length"), 6).alias("shared_part"))
