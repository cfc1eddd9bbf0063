"""Problem 1: near-duplicate records by the word sets they share.

Plan: exact copies collapse first, then records with the same set of words collapse to classes. Class
representatives get 128 MinHash values; 32 bands of two values each give the candidates (a pair at the
threshold 0.6 shares no band with probability (1 - 0.36)^32 = 6e-7). Candidates are pruned within the band join by
comparing MinHash values incrementally: two bits of 32, 64, 96, then all 128 values, and a pair is dropped as soon as the
posterior probability that its similarity reaches the threshold is below `tolerance`. What is left is verified on the real
word sets, so the result has no false pair.

A band bucket that holds many rows is split by the adaptive skew join, no row of it is dropped, and pairs that share
an adapter or another common stretch, however many, fall to the comparison before they are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.arrow import gathered
from readloom.functions.packed import Batch, first_of_runs, mix
from readloom.functions.reads import distinct_sequences
from readloom.session import written

N_HASH, BANDS, ROWS = 128, 32, 2  # MinHash values; the first BANDS * ROWS make the bands
LANES, BITS = 32, 2  # of LANES values a long holds BITS bits each
LONGS = N_HASH // LANES
LANE_COLUMNS = [f"lane{i + 1}" for i in range(LONGS)]


def least_agreement(n: int, threshold: float, tolerance: float, chance: float = 0.0) -> int:
    """Fewest of n agreeing values at which P(similarity >= threshold | agreements) >= tolerance.

    Uniform prior on the similarity s; a value agrees with probability s + (1 - s) * chance.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) * chance
    for m in range(n + 1):
        logs = lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(p) + (n - m) * np.log1p(-p)
        like = np.exp(logs - logs.max())
        if like[s >= threshold].sum() / like.sum() >= tolerance:
            return m
    return n + 1


def _words(batch: Batch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, canonical k-mer) of a batch, in that order."""
    ok = batch.valid(k)
    row, word = batch.row[: len(ok)][ok].astype(np.uint64), batch.canonical(k)[ok]
    if 2 * k + max(batch.n, 1).bit_length() <= 64:
        both = np.sort((row << np.uint64(2 * k)) | word)
        both = both[first_of_runs(both)]
        return (both >> np.uint64(2 * k)).astype(np.int64), both & np.uint64((1 << 2 * k) - 1)
    order = np.lexsort((word, row))
    row, word = row[order], word[order]
    first = first_of_runs(row, word)
    return row[first].astype(np.int64), word[first]


def _sign(batches: Iterator[pa.RecordBatch], k: int, seed: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 2**31, N_HASH, np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 2**32, N_HASH, np.uint32)
    for t in gathered(batches, "seq", 1_000_000):
        row, word = _words(Batch(t.column("seq")), k)
        starts = first_of_runs(row)
        rows = row[starts]
        if not len(rows):
            continue
        h1, h2 = mix(word, 1), mix(word, 2)
        sig = np.empty((len(rows), N_HASH), np.uint32)
        x = (h1 >> np.uint64(32)).astype(np.uint32)
        for i in range(N_HASH):
            sig[:, i] = np.minimum.reduceat(x * mul[i] + add[i], starts)
        counts = np.diff(np.append(starts, len(row)))
        lanes = np.zeros((len(rows), LONGS), np.uint64)
        low = mix(sig.astype(np.uint64), 3) & np.uint64((1 << BITS) - 1)
        for i in range(N_HASH):
            lanes[:, i // LANES] |= low[:, i] << np.uint64(BITS * (i % LANES))
        bands = mix(mix(sig[:, 0 : BANDS * ROWS : 2].astype(np.uint64), 4) ^ sig[:, 1 : BANDS * ROWS : 2] ^ (np.arange(BANDS, dtype=np.uint64) << np.uint64(40)), 5)
        took = t.take(pa.array(rows))
        n = len(rows)
        yield pa.RecordBatch.from_arrays(
            [
                took.column("seq_id").combine_chunks(),
                took.column("seq").combine_chunks(),
                pa.array(counts.astype(np.int64)),
                pa.array(np.add.reduceat(h1, starts).view(np.int64)),
                pa.array(np.add.reduceat(h2, starts).view(np.int64)),
                *[pa.array(lanes[:, i].copy().view(np.int64)) for i in range(LONGS)],
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1).view(np.int64))),
            ],
            names=["seq_id", "seq", "n_words", "set1", "set2", *LANE_COLUMNS, "bands"],
        )


def _lanes_agree(a: Column, b: Column) -> Column:
    """How many of the LANES lanes of two longs agree."""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    return LANES - F.bit_count(x.bitwiseAND(F.lit(sum(1 << BITS * i for i in range(LANES)))))


def _verify(batches: Iterator[pa.RecordBatch], k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for t in gathered(batches, "seq_a", 500_000):
        keys = []
        for c in ("seq_a", "seq_b"):
            row, word = _words(Batch(t.column(c)), k)
            keys.append(np.rec.fromarrays([row, word]) if 2 * k > 40 else (row.astype(np.uint64) << np.uint64(2 * k)) | word)
        if 2 * k > 40:
            shared = np.intersect1d(*keys, assume_unique=True)
        else:
            shared = np.sort(np.concatenate(keys))
            shared = shared[:-1][shared[1:] == shared[:-1]]
        rows = shared["f0"] if 2 * k > 40 else (shared >> np.uint64(2 * k)).astype(np.int64)
        both = np.bincount(rows, minlength=t.num_rows)
        either = t.column("n_a").to_numpy() + t.column("n_b").to_numpy() - both
        ok = both >= threshold * either - 1e-9
        out = t.filter(pa.array(ok)).select(["a", "b"]).append_column("identity", pa.array((both / np.maximum(either, 1))[ok]))
        yield from out.to_batches()


def similar_pairs(reads: DataFrame, k: int = 12, threshold: float = 0.6, tolerance: float = 1e-6, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate classes and the similar pairs between them.

    reads: (read_id, seq), any number of rows per read. Returns
      members (seq_id, class_id, n_reads): every distinct upper-case sequence that has a word, named by its lowest
        read_id; class_id is the lowest seq_id with the same set of words;
      pairs (class_a, class_b, identity): classes whose word sets have Jaccard similarity >= threshold, a < b.
    Words are k bases, a word and its reverse complement being one. Null, empty and too short sequences, and
    sequences without k plain bases on end, have no words and appear in neither result.
    """
    distinct = distinct_sequences(reads)
    schema = "seq_id bigint, seq string, n_words bigint, set1 bigint, set2 bigint, " + "".join(f"{c} bigint, " for c in LANE_COLUMNS) + "bands array<bigint>"
    signed, _ = written(distinct.select("seq_id", "seq").mapInArrow(lambda it: _sign(it, k, seed), schema), "sign")
    classes = signed.groupBy("set1", "set2", "n_words").agg(F.min("seq_id").alias("class_id"))
    members = signed.join(classes, ["set1", "set2", "n_words"]).select("seq_id", "class_id")
    reps = signed.join(classes.select("class_id"), F.col("seq_id") == F.col("class_id"), "left_semi")

    bands = reps.select(F.explode("bands").alias("band"), "seq_id", *LANE_COLUMNS)
    a, b = bands.alias("a"), bands.alias("b")
    on, agree = (F.col("a.band") == F.col("b.band")) & (F.col("a.seq_id") < F.col("b.seq_id")), F.lit(0)
    for step in range(1, LONGS + 1):
        agree = agree + _lanes_agree(F.col(f"a.lane{step}"), F.col(f"b.lane{step}"))
        on &= agree >= least_agreement(step * LANES, threshold, tolerance, 1 / 2**BITS)
    pairs, _ = written(a.join(b, on).select(F.col("a.seq_id").alias("a"), F.col("b.seq_id").alias("b")).distinct(), "pairs")
    side = lambda x: signed.select(F.col("seq_id").alias(x), F.col("seq").alias(f"seq_{x}"), F.col("n_words").alias(f"n_{x}"))
    found = (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .select("a", "b", "seq_a", "seq_b", "n_a", "n_b")
        .mapInArrow(lambda it: _verify(it, k, threshold), "a bigint, b bigint, identity double")
    )
    return members, found.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "identity")


def expand_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs (read_id1 < read_id2) of different sequences: within classes and between similar classes."""
    m, n = members.alias("m"), members.alias("n")
    within = m.join(n, (F.col("m.class_id") == F.col("n.class_id")) & (F.col("m.seq_id") < F.col("n.seq_id"))).select(F.col("m.seq_id").alias("x"), F.col("n.seq_id").alias("y"))
    between = (
        pairs.join(members.select(F.col("class_id").alias("class_a"), F.col("seq_id").alias("x")), "class_a")
        .join(members.select(F.col("class_id").alias("class_b"), F.col("seq_id").alias("y")), "class_b")
        .select("x", "y")
    )
    return between.unionByName(within).select(F.least("x", "y").alias("read_id1"), F.greatest("x", "y").alias("read_id2"))
