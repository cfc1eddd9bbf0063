"""Reads as a relation: one row per read, one row per distinct sequence, names without header parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bare_name(name: Column) -> Column:
    """The name without a leading > or @ and without anything from the first blank on; null or '' gives null."""
    bare = F.regexp_extract(name, r"^\s*[>@]?([^\s]*)", 1)
    return F.when(bare != "", bare)


def one_per_read(reads: DataFrame, read_id: str = "read_id", keep: tuple[str, ...] = ("name", "seq")) -> DataFrame:
    """One row per non-null read_id: of rows sent again the first loaded counts (then lowest file, read_idx)."""
    first = F.struct(*[F.col(c) for c in ("loaded_at", "file", "read_idx") if c in reads.columns])
    return (
        reads.where(F.col(read_id).isNotNull())
        .groupBy(F.col(read_id).alias("read_id"))
        .agg(F.min_by(F.struct(*[F.col(c) for c in keep]), first).alias("r"))
        .select("read_id", *[F.col("r")[c].alias(c) for c in keep])
    )


def distinct_sequences(reads: DataFrame) -> DataFrame:
    """(seq_id, seq, weight): upper-case sequences, each named by its lowest read_id, with its number of reads.

    Null and empty sequences are left out. Exact copies, however many, become one row before any
    further work (map-side combine makes a hot sequence one row per task in the shuffle).
    """
    return (
        reads.select("read_id", F.upper("seq").alias("seq"))
        .where(F.length("seq") > 0)
        .groupBy("seq")
        .agg(F.min("read_id").alias("seq_id"), F.count("*").alias("weight"))
        .select("seq_id", "seq", "weight")
    )


def numbered(reads: DataFrame, *order: str) -> DataFrame:
    """reads with __id, a bigint unique per row (in the order of the given columns, if any), as a written table: the numbers stay what they are however often it is read."""
    from readloom.session import written

    src = reads.repartitionByRange(*order).sortWithinPartitions(*order) if order else reads
    return written(src.withColumn("__id", F.monotonically_increasing_id()), "numbered")[0]
