"""Reads as they arrive: running k-mer counts, late mates, and fan-out to several sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from readloom.functions.names import mate_base, mate_number
from readloom.operators.kmers import windows


def arriving(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Parquet reads that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_counts(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, cnt) so far; for output modes update and complete."""
    return windows(reads, k, []).groupBy("kmer").agg(F.count("*").alias("cnt"))


def reads_per_window(reads: DataFrame, time: str, late: str = "3 hours", width: str = "1 hour") -> DataFrame:
    """(start, file, n_reads, n_bases) per time window and file; rows later than `late` are left out."""
    w = reads.withWatermark(time, late).groupBy(F.window(time, width), "file").agg(F.count("*").alias("n_reads"), F.sum(F.length("seq")).alias("n_bases"))
    return w.select(F.col("window.start").alias("start"), "file", "n_reads", "n_bases")


def matched_mates(reads: DataFrame, time: str, wait: str = "1 hour") -> DataFrame:
    """(base, seq1, seq2, status): a pair as soon as both mates are there ('pair'); a mate whose partner does not come within `wait` of event time alone ('single').

    A name without a mate number is left out; of a mate sent again the first counts.
    """
    delay = pd.Timedelta(wait) // pd.Timedelta("1ms")

    def match(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq1, seq2 = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"base": [key[0]], "seq1": [seq1], "seq2": [seq2], "status": ["single"]})
            return
        latest = 0
        for b in batches:
            for n, s, t in zip(b["n"], b["seq"], b["t"], strict=True):
                latest = max(latest, int(t))
                if n == 1 and seq1 is None:
                    seq1 = s or ""
                elif n == 2 and seq2 is None:
                    seq2 = s or ""
        if seq1 is not None and seq2 is not None:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"base": [key[0]], "seq1": [seq1], "seq2": [seq2], "status": ["pair"]})
            return
        state.update((seq1, seq2))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + delay)

    r = reads.withWatermark(time, wait).select(F.col(time), mate_base(F.col("name")).alias("base"), mate_number(F.col("name")).alias("n"), "seq", F.unix_millis(time).alias("t")).where("n is not null")
    return r.groupBy("base").applyInPandasWithState(match, "base string, seq1 string, seq2 string, status string", "seq1 string, seq2 string", "append", GroupStateTimeout.EventTimeTimeout)


def fan_out(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Each micro-batch once to every sink (a function of the batch and its number)."""

    def each(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            for s in sinks:
                s(batch, n)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
