"""Repeat masks, repetitiveness and read histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import mask as M
from readloom.plans.sqlkit import READS, counts_sql, reads

QUERIES, ORACLE = {}, {}
KM, LEAST = 12, 20


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def one(spark, d) -> DataFrame:
    """One read per name, qualities as long as the sequence."""
    from readloom.functions.dna import full_quality

    r = reads(spark, d).groupBy("name").agg(F.min_by(F.struct("seq", "qual"), "file").alias("r")).select("name", "r.seq", "r.qual")
    return r.withColumn("qual", full_quality(F.col("seq"), F.col("qual"), 20))


ONE = f"""WITH {READS}, o AS (SELECT name, arg_min(seq, file) AS seq, arg_min(struct_pack(q := qual), file).q AS q0 FROM reads GROUP BY name),
one AS (SELECT name, seq, CASE WHEN q0 IS NULL OR len(q0) < length(seq) THEN list_transform(range(length(seq)), lambda x: 20) ELSE q0[1:length(seq)] END AS qual FROM o), {counts_sql(KM, "one")}"""
RUNS = f"""bs AS (SELECT name, p - 1 AS pos, substr(seq, p, 1) AS b FROM (SELECT name, seq, unnest(range(1, length(seq) + 1)) AS p FROM one)),
pl AS (SELECT name, pos, pos - row_number() OVER (PARTITION BY name ORDER BY pos) AS g FROM bs WHERE b SIMILAR TO '[ACGTacgt]'),
rn AS (SELECT name, pos, min(pos) OVER (PARTITION BY name, g) AS start, max(pos) OVER (PARTITION BY name, g) + 1 AS stop FROM pl),
hit AS (SELECT w.name, w.pos FROM kc_w w JOIN kc USING (kmer) WHERE kc.cnt >= {LEAST})"""


def mask_sql(x: int, k: int = KM) -> str:
    return f"""{RUNS}, c AS (SELECT rn.*, count(hit.pos) OVER (PARTITION BY rn.name, start ORDER BY rn.pos ROWS {k - 1} PRECEDING) AS c FROM rn LEFT JOIN hit ON rn.name = hit.name AND rn.pos = hit.pos WHERE stop - start >= {k}),
s AS (SELECT *, CASE WHEN c >= {x} THEN 1 WHEN c < least(pos, stop - {k}) - CASE WHEN pos <= stop - {k} THEN greatest(start, pos - {k - 1}) ELSE pos - {k - 1} END + 1 THEN 0 END AS state FROM c),
f AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY name, start ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
  first_value(state IGNORE NULLS) OVER (PARTITION BY name, start ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM s),
mk AS MATERIALIZED (SELECT name, pos FROM f WHERE coalesce(state, CASE WHEN l = 1 THEN 1 END, r, 0) = 1)"""


def masked(spark, d, x=1):
    return M.masked_reads(one(spark, d), KM, LEAST, coverage=x)


@query("w2_repeat_mask", f"{ONE}, {mask_sql(1)} SELECT name, pos FROM mk")
def w2(spark, d):
    return M.masked_positions(masked(spark, d))


@query("w2_repeat_mask_coverage3", f"{ONE}, {mask_sql(3)} SELECT name, pos FROM mk")
def w2_x(spark, d):
    return M.masked_positions(masked(spark, d, 3))


ANCHOR = f"""{ONE}, {mask_sql(1)}, op AS MATERIALIZED (SELECT bs.name, bs.pos, b, one.qual[bs.pos + 1] AS q, mk.pos IS NOT NULL AS masked FROM bs JOIN one USING (name) LEFT JOIN mk ON bs.name = mk.name AND bs.pos = mk.pos),
st AS (SELECT name, min(pos) AS a, max(pos) AS b FROM (SELECT *, pos - row_number() OVER (PARTITION BY name ORDER BY pos) AS g FROM op WHERE NOT masked AND b SIMILAR TO '[ACGTacgt]') GROUP BY name, g HAVING count(*) FILTER (q >= 20) >= 15),
en AS MATERIALIZED (SELECT name, min(a) AS lo, max(b) AS hi FROM st GROUP BY name)"""


@query("w3_anchored_mask", f"{ANCHOR} SELECT op.name, op.pos FROM op LEFT JOIN en USING (name) WHERE masked AND (lo IS NULL OR op.pos < lo OR op.pos > hi)")
def w3(spark, d):
    return M.masked_positions(M.anchored_mask(masked(spark, d), 15))


LISTED = f"{ONE}, {mask_sql(1)}, ml AS (SELECT name, list(pos) AS m FROM mk GROUP BY name)"


@query("w4_apply_mask_x", f"{LISTED} SELECT name, CASE WHEN seq = '' THEN '' ELSE array_to_string(list_transform(range(length(seq)), lambda i: CASE WHEN list_contains(coalesce(m, []), i) THEN 'X' ELSE substr(seq, i + 1, 1) END), '') END AS seq FROM one LEFT JOIN ml USING (name)")
def w4(spark, d):
    return M.apply_mask(masked(spark, d))


@query("w4_apply_mask_lower", f"{LISTED} SELECT name, CASE WHEN seq = '' THEN '' ELSE array_to_string(list_transform(range(length(seq)), lambda i: CASE WHEN list_contains(coalesce(m, []), i) THEN lower(substr(seq, i + 1, 1)) ELSE upper(substr(seq, i + 1, 1)) END), '') END AS seq FROM one LEFT JOIN ml USING (name)")
def w4_lower(spark, d):
    return M.apply_mask(masked(spark, d), "lower")


@query("w5_masked_ranges", f"{ONE}, {mask_sql(1)} SELECT name, min(pos) AS start, max(pos) + 1 AS stop FROM (SELECT *, pos - row_number() OVER (PARTITION BY name ORDER BY pos) AS g FROM mk) GROUP BY name, g")
def w5(spark, d):
    return M.masked_ranges(masked(spark, d))


@query("w5_masked_percent", f"{ONE}, {mask_sql(1)} SELECT name, round(100.0 * count(*) / any_value(length(seq)), 2) AS masked_pct FROM mk JOIN one USING (name) GROUP BY name")
def w5_pct(spark, d):
    return M.masked_percent(masked(spark, d))


REP = f"{ONE}, rp AS (SELECT w.name, w.kmer, kc.cnt >= {LEAST} AS rep FROM kc_w w JOIN kc USING (kmer)), rs AS (SELECT name, count(*) AS kmers, count(*) FILTER (rep) AS r_kmers, count(DISTINCT kmer) FILTER (rep) AS ur_kmers FROM rp GROUP BY name)"


@query("a17_repetitiveness", f"{REP} SELECT name, kmers, r_kmers, ur_kmers, round(100.0 * r_kmers / kmers, 4) AS r_pct, round(CASE WHEN r_kmers > 0 THEN 100.0 * ur_kmers / r_kmers END, 4) AS ur_pct FROM rs")
def a17(spark, d):
    return M.repetitiveness(one(spark, d), KM, LEAST)


@query("a18_read_histogram", f"""{ONE}, th AS (SELECT unnest(range(2, 21) || range(25, 101, 5)) AS threshold), n AS (SELECT name, count(*) AS kmers FROM kc_w GROUP BY name),
r AS (SELECT w.name, threshold, count(*) AS r, count(DISTINCT kmer) AS u FROM kc_w w JOIN kc USING (kmer) JOIN th ON kc.cnt >= th.threshold GROUP BY ALL),
b AS (SELECT threshold::INT AS threshold, unnest([(20 * r - 1) // kmers, (20 * u - 1) // r]) AS bin, unnest([0, 1]) AS t FROM r JOIN n USING (name))
SELECT threshold, bin, count(*) FILTER (t = 0) AS n_reads, count(*) FILTER (t = 1) AS n_reads_distinct FROM b GROUP BY ALL""")
def a18(spark, d):
    return M.read_histogram(one(spark, d), KM)


@query("a19_unique_high_quality", f"{ONE}, {mask_sql(1)} SELECT bs.name, count(*) AS n FROM bs JOIN one USING (name) LEFT JOIN mk ON bs.name = mk.name AND bs.pos = mk.pos WHERE mk.pos IS NULL AND b SIMILAR TO '[ACGTacgt]' AND one.qual[bs.pos + 1] >= 20 GROUP BY bs.name")
def a19(spark, d):
    return M.unique_high_quality(masked(spark, d))


@query("j1_kmer_count_lookup", f"{ONE} SELECT w.name, max(cnt) AS top, sum(cnt)::BIGINT AS total FROM kc_w w JOIN kc USING (kmer) GROUP BY w.name")
def j1(spark, d):
    return M.kmer_totals(one(spark, d), KM)
