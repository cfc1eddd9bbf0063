"""Problem 7: frequency of every distinct term, with the number of records that hold it.

Last-seen counters: tokens are hash-partitioned by term and ordered by term and record; a term has its occurrences, its records and the last
record seen, and a record counts only if it is not the term's last one, so no per-record set is kept and a task holds one counter. A
part of the records' hash goes into the partitioning too, so a term that a third of all records hold is spread over many tasks; a record's tokens of a
term still meet in one, so the counters of a term's parts add up.

Words of bases need no token rows: a record is one row there, so the counters run over a batch's words, sorted by term and record, and batches add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.arrow import gathered
from readloom.functions.packed import Batch, first_of_runs, letters
from readloom.functions.reads import distinct_sequences


def _count(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for t in gathered(batches, "seq", 1_000_000):
        b = Batch(t.column("seq"))
        ok = b.valid(k)
        term, record = b.canonical(k)[ok], b.row[: len(ok)][ok]
        weight = t.column("weight").to_numpy().astype(np.int64)[record]
        order = np.argsort(term, kind="stable")  # records stay in order within a term
        term, record, weight = term[order], record[order], weight[order]
        starts = first_of_runs(term)
        if not len(starts):
            continue
        last_seen = np.zeros(len(term), bool)
        last_seen[1:] = (term[1:] == term[:-1]) & (record[1:] == record[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(term[starts].view(np.int64)), pa.array(np.add.reduceat(weight, starts)), pa.array(np.add.reduceat(np.where(last_seen, 0, weight), starts))],
            names=["term", "n", "r"],
        )


def _spell(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([letters(b.column(0).to_numpy().view(np.uint64), k), *b.columns[1:]], names=["term", *b.schema.names[1:]])


def mark(records: Column, least: int, below: int) -> Column:
    """'rare' under `least` records, 'common' from `below` records on, else 'kept'."""
    return F.when(records < least, "rare").when(records >= below, "common").otherwise("kept")


def base_word_counts(reads: DataFrame, k: int, least: int, below: int, only: str | None = None) -> DataFrame:
    """(term, occurrences, records, mark) of every word of k <= 32 bases (either strand) in (read_id, seq) rows.

    One row per read is expected. Exact copies of a sequence are counted by weight. `only` keeps one mark, before the terms
    are spelled out. Null, empty and short sequences hold no words.
    """
    counts = distinct_sequences(reads).select("seq", "weight").mapInArrow(lambda it: _count(it, k), "term bigint, n bigint, r bigint")
    counts = counts.repartition("term")  # already combined by batch: another combining before the shuffle would only fill memory
    total = counts.groupBy("term").agg(F.sum("n").alias("occurrences"), F.sum("r").alias("records"))
    total = total.withColumn("mark", mark(F.col("records"), least, below))
    if only:
        total = total.where(F.col("mark") == only)
    return total.mapInArrow(lambda it: _spell(it, k), "term string, occurrences bigint, records bigint, mark string")


PARTS = 64  # a term's records are counted in so many parts


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens (term, record, part) of a batch as (term, record, part, n)."""
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b]).group_by(["term", "record", "part"], use_threads=False).aggregate([([], "count_all")])
            yield from t.select(["term", "record", "part", "count_all"]).rename_columns(["term", "record", "part", "n"]).to_batches()


def _changed(column: pa.Array, before) -> np.ndarray:
    """Where a value differs from the one before it, `before` being the value before the first."""
    new = np.ones(len(column), bool)
    if len(column) > 1:
        new[1:] = pa.compute.fill_null(pa.compute.not_equal(column.slice(1), column.slice(0, len(column) - 1)), True).to_numpy(zero_copy_only=False)
    new[0] = before is None or column[0].as_py() != before
    return new


def _last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n, r) of rows (term, record, part, n) sorted by term and record: one counter goes along, with the last record seen."""
    term = record = None
    occurrences = records = 0
    for b in batches:
        if not b.num_rows:
            continue
        new_term = _changed(b.column(0), term)
        new_record = new_term | _changed(b.column(1), record)
        starts = np.flatnonzero(new_term)
        n, r = b.column(3).to_numpy().astype(np.int64), new_record.astype(np.int64)
        head = int(starts[0]) if len(starts) else b.num_rows  # rows that go on with the term before
        occurrences, records = occurrences + int(n[:head].sum()), records + int(r[:head].sum())
        if len(starts):
            sums_n, sums_r = np.add.reduceat(n, starts), np.add.reduceat(r, starts)
            done = b.column(0).take(pa.array(starts[:-1]))
            if term is not None:
                yield pa.RecordBatch.from_arrays([pa.array([term], b.column(0).type), pa.array([occurrences]), pa.array([records])], names=["term", "n", "r"])
            if len(done):
                yield pa.RecordBatch.from_arrays([done, pa.array(sums_n[:-1]), pa.array(sums_r[:-1])], names=["term", "n", "r"])
            term, occurrences, records = b.column(0)[int(starts[-1])].as_py(), int(sums_n[-1]), int(sums_r[-1])
            kind = b.column(0).type
        record = b.column(1)[b.num_rows - 1].as_py()
    if term is not None:
        yield pa.RecordBatch.from_arrays([pa.array([term], kind), pa.array([occurrences]), pa.array([records])], names=["term", "n", "r"])


def term_counts(df: DataFrame, record: str, terms: Column, least: int, below: int) -> DataFrame:
    """(term, occurrences, records, mark) of an array column's elements, e.g. the words of a text.

    Rows with the same record id are one record, wherever they are. Null ids, null arrays and null elements count nothing.
    """
    tokens = df.where(F.col(record).isNotNull()).select(F.explode(terms).alias("term"), F.col(record).alias("record"), F.pmod(F.xxhash64(record), F.lit(PARTS)).cast("int").alias("part")).where("term is not null")
    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema}
    own = ", ".join(f"{c} {kinds[c]}" for c in ("term", "record", "part"))
    combined = tokens.mapInArrow(_combined, f"{own}, n bigint")
    ordered = combined.repartition("term", "part").sortWithinPartitions("term", "record")
    counted = ordered.mapInArrow(_last_seen, f"term {kinds['term']}, n bigint, r bigint")
    return counted.groupBy("term").agg(F.sum("n").alias("occurrences"), F.sum("r").alias("records")).withColumn("mark", mark(F.col("records"), least, below))
