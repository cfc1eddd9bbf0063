"""Sizes of texts in tokens of a public byte-pair vocabulary (never trained here; its file's path is a parameter)."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the vocabulary's word pattern
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHE: dict = {}


def encoding(path: str):
    if path not in _CACHE:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CACHE[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _CACHE[path]


def _sizes(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoding(path)
    for b in batches:
        n = [len(enc.encode_ordinary(x.as_py())) for x in b.column(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])


def with_sizes(documents: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The columns in keep and n_tokens of every row with a text that is not null or empty."""
    fields = {f.name: f.dataType.simpleString() for f in documents.schema}
    return (
        documents.where(F.length(text) > 0)
        .select(*keep, text)
        .mapInArrow(lambda it: _sizes(it, path), ", ".join([f"`{c}` {fields[c]}" for c in keep] + ["n_tokens bigint"]))
    )
