"""The base and name functions as temporary SQL functions (plain SQL bodies, so Catalyst inlines them; no Python at run time)."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "base_code(c STRING) RETURNS INT": "IF(length(c) = 1, instr('ACGT', upper(c)) - 1, -1)",
    "reverse_complement(s STRING) RETURNS STRING": "reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))",
    "canonical_kmer(s STRING) RETURNS STRING": "least(s, reverse(translate(s, 'ACGT', 'TGCA')))",
    "gc_count(s STRING) RETURNS INT": "length(s) - length(translate(s, 'GC', ''))",
    "bare_name(s STRING) RETURNS STRING": r"nullif(regexp_extract(s, '^\\s*[>@]?([^\\s]*)', 1), '')",
    "phred(s STRING) RETURNS ARRAY<INT>": "transform(split(s, ''), c -> greatest(0, least(255, ascii(c) - 33)))",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions usable in spark.sql(); returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.partition("(")[0] for h in FUNCTIONS]
