"""Queries of problem 3, which is solved in the core package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readloom.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from readloom.operators.parse_errors import parse_match_lines

    return parse_match_lines(table(spark, d, "match_line"))[1].select("line_id", "reason")


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    from readloom.operators.parse_errors import parse_match_lines

    return parse_match_lines(table(spark, d, "match_line"))[0]


# DuckDB's engine has no possessive quantifiers; its matching is linear anyway
_F = r'(?:"(?:[^"]|"")*"|[^ \t\r"]+)'
_B = r"[ \t\r]"
_PARSE = f"""
WITH t AS (
  SELECT line_id, coalesce(raw_line, '') AS raw,
    regexp_matches(coalesce(raw_line, ''), '^{_B}*(?:{_F}(?:{_B}+{_F})*)?{_B}*\\z') AS lexed,
    regexp_matches(coalesce(raw_line, ''), '^{_B}*{_F}(?:{_B}+{_F}){{6}}{_B}*\\z') AS seven
  FROM match_line),
f AS (
  SELECT line_id, lexed, seven, list_transform(regexp_extract_all(raw, '{_F}'),
    lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS p FROM t),
n AS (
  SELECT line_id, lexed, seven, p, list_transform(p[3:7], lambda x: CASE WHEN regexp_matches(x, '^[0-9]+\\z') THEN
    CASE WHEN length(ltrim(x, '0')) <= 9 THEN coalesce(try_cast(x AS bigint), 0) ELSE 999999999 END END) AS v FROM f),
g AS (
  SELECT *, coalesce(trim(p[1], ' ' || chr(9) || chr(13)) <> '' AND trim(p[2], ' ' || chr(9) || chr(13)) <> '' AND v[1] BETWEEN 1 AND 65535
    AND v[2] <= v[1] AND v[3] <= v[2] AND v[4] <= 15 AND v[5] IN (0, 1), FALSE) AS good FROM n)
"""

QUERIES = {"p3_found": p3_found, "p3_loaded": p3_loaded}
ORACLE = {
    "p3_found": _PARSE + "SELECT line_id, CASE WHEN NOT lexed THEN 'quoting' WHEN NOT seven THEN 'columns' ELSE 'value' END AS reason FROM g WHERE NOT (lexed AND seven AND good)",
    "p3_loaded": _PARSE
    + """SELECT line_id, p[1] AS read1, p[2] AS read2, v[1]::INT AS read_length, v[2]::INT AS match_length,
  v[3]::INT AS identity, v[4]::INT AS gap, v[5]::INT AS flag FROM g WHERE lexed AND seven AND good""",
}
