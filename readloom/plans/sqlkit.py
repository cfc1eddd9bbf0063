"""Fixtures shared by the reference-operator queries, in DataFrame and in DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.reads import first_of_name
from readloom.session import table


def reads(spark: SparkSession, d: str) -> DataFrame:
    """file, read_idx, read_id, name, comment, seq (never null), qual; the first row of each name in a file."""
    return first_of_name(table(spark, d, "raw_read")).select("file", "read_idx", "read_id", "name", "comment", F.coalesce("seq", F.lit("")).alias("seq"), "qual")


READS = """reads AS (SELECT file, read_idx, read_id, name, comment, coalesce(seq, '') AS seq, qual FROM raw_read
  QUALIFY row_number() OVER (PARTITION BY file, name ORDER BY read_idx) = 1)"""


def windows_sql(k: int, src: str = "reads", keep: str = "name", canonical: bool = True, name: str = "win") -> str:
    key = "least(w, reverse(translate(w, 'ACGT', 'TGCA')))" if canonical else "w"
    return f"""{name} AS (SELECT {keep}, p - 1 AS pos, {key} AS kmer FROM
  (SELECT {keep}, p, substr(upper(seq), p, {k}) AS w FROM (SELECT {keep}, seq, unnest(range(1, length(seq) - {k} + 2)) AS p FROM {src}))
  WHERE regexp_full_match(w, '[ACGT]{{{k}}}'))"""


def counts_sql(k: int, src: str = "reads", keep: str = "name", name: str = "kc") -> str:
    return windows_sql(k, src, keep, name=f"{name}_w") + f", {name} AS (SELECT kmer, count(*) AS cnt FROM {name}_w GROUP BY kmer)"
