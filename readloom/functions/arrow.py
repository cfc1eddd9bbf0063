"""Small helpers for mapInArrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the column's text in one piece stays near `most` bytes (a longer row comes alone)."""
    i = None
    for batch in batches:
        i = batch.schema.get_field_index(column)
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(i)), 0).to_pylist()
        start = total = 0
        for k, n in enumerate(sizes):
            if total + n > most and k > start:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.Table]:
    """Join small batches (and cut large ones) to pieces of about `most` bytes of the column."""
    have: list[pa.RecordBatch] = []
    total = 0
    for batch in slices(batches, column, most):
        n = pa.compute.sum(pa.compute.binary_length(batch.column(batch.schema.get_field_index(column)))).as_py() or 0
        if have and total + n > most:
            yield pa.Table.from_batches(have)
            have, total = [], 0
        have.append(batch)
        total += n
    if have:
        yield pa.Table.from_batches(have)
