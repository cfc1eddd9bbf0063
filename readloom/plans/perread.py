"""Sequential per-read logic, repair, name forms, and the streams run to their end."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from readloom.functions import names as N
from readloom.operators import align as A
from readloom.operators import prep as P
from readloom.operators import reads as R
from readloom.operators import repair as X
from readloom.plans.masking import ONE, one
from readloom.plans.sqlkit import READS, reads, windows_sql
from readloom.plans.tables import PSL, psl
from readloom.session import table

QUERIES, ORACLE = {}, {}
ADAPTER = "AGATCGGAAGAGCACACGTC"  # an example linker
LINKERS = frozenset(ADAPTER[i : i + 12] for i in range(len(ADAPTER) - 11))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("trim_n", f"""{ONE}, s AS (SELECT name, regexp_replace(regexp_replace(upper(seq), '^N+', ''), 'N+$', '') AS s FROM one)
SELECT name, CASE WHEN s = '' OR regexp_matches(s, '^[^N]NN') THEN NULL WHEN regexp_matches(s, '^[^N]N') THEN substr(s, 3) WHEN regexp_matches(s, '^[^N]*NN') THEN split_part(s, 'N', 1)
  WHEN length(s) - length(replace(s, 'N', '')) >= 2 THEN split_part(s, 'N', 1) || 'N' || split_part(s, 'N', 2) ELSE s END AS seq FROM s""")
def p12(spark, d):
    return one(spark, d).select("name", R.trim_n(F.upper("seq")).alias("seq"))


BASES = "bs AS (SELECT name, p - 1 AS pos, substr(seq, p, 1) AS b, length(seq) AS n FROM (SELECT name, {seq} AS seq, unnest(range(1, length(seq) + 1)) AS p FROM one))"


@query("repeat_tail_clip", f"""{ONE}, {BASES.format(seq="seq")}, c AS (SELECT *, CASE WHEN b = lag(b) OVER (PARTITION BY name ORDER BY pos) THEN 0 ELSE 1 END AS new FROM bs),
r AS (SELECT *, sum(new) OVER (PARTITION BY name ORDER BY pos) AS run FROM c), e AS (SELECT *, max(run) OVER (PARTITION BY name) - run + 1 AS runs, max(pos) OVER (PARTITION BY name, run) + 1 AS stop FROM r),
t AS (SELECT name, min(pos) AS tail FROM e WHERE pos > 0 AND n - pos >= runs * 2.5 GROUP BY name),
k AS (SELECT name, min(pos) AS cut FROM e JOIN t USING (name) WHERE (pos = tail OR (new = 1 AND pos > tail)) AND stop - pos >= 2 GROUP BY name) SELECT name, coalesce(cut, length(seq))::BIGINT AS q_stop FROM one LEFT JOIN k USING (name)""")
def p3(spark, d):
    return P.per_batch(one(spark, d), lambda b: [P.repeat_tails(b, 2.5)], "seq", ["name"], "q_stop bigint")


@query("strict_window_clip")
def p4(spark, d):
    return P.per_read(one(spark, d), lambda s, q: P.strict_window(q, [(0, len(s))], 25, s, 0.8), ["seq", "qual"], ["name"], "q_start bigint, q_stop bigint")


# the gap between flagged bases that a base lies in
GAP_SQL = "CASE WHEN {f} THEN 0 ELSE coalesce(first_value(CASE WHEN {f} THEN pos END IGNORE NULLS) OVER (PARTITION BY name ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - last_value(CASE WHEN {f} THEN pos END IGNORE NULLS) OVER (PARTITION BY name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 1000000) END"
LINKED = f"""{ONE}, {BASES.format(seq="upper(seq)")}, {windows_sql(12, "one", canonical=False, name="lw")}, lh AS (SELECT name, pos FROM lw WHERE kmer IN ({', '.join(repr(x) for x in sorted(LINKERS))})),
cv AS (SELECT bs.*, count(lh.pos) OVER (PARTITION BY bs.name ORDER BY bs.pos ROWS 11 PRECEDING) > 0 AS covered FROM bs LEFT JOIN lh ON bs.name = lh.name AND bs.pos = lh.pos WHERE bs.name IN (SELECT name FROM lh)),
mk AS (SELECT *, covered OR (b = 'N' AND {GAP_SQL.format(f="covered")} < 18) AS marked FROM cv), wh AS (SELECT *, {GAP_SQL.format(f="marked")} <= 5 AS whole FROM mk),
rg AS (SELECT name, min(pos) AS a, max(pos) + 1 AS e, min(n) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY name ORDER BY pos) AS g FROM wh WHERE whole) GROUP BY name, g HAVING bool_or(covered)),
fr AS (SELECT name, min(a) AS first FROM rg WHERE e - a >= 18 OR n - a <= 36 OR e <= 36 GROUP BY name)"""


@query("linker_range_clip", f"{LINKED} SELECT name, 0::BIGINT AS start, (CASE WHEN coalesce(first, length(seq)) < 50 THEN 0 ELSE coalesce(first, length(seq)) END)::BIGINT AS stop FROM one LEFT JOIN fr USING (name)")
def p14(spark, d):
    words = P.packed_words(LINKERS, 12)
    return P.per_batch(one(spark, d), lambda b: list(P.linker_clips(b, np.zeros(b.n, np.int64), b.lengths, words, 12, 50)), "seq", ["name"], "start bigint, stop bigint")


@query("linker_ranges", f"{LINKED} SELECT name, a AS start, e AS stop FROM rg")
def j19(spark, d):
    """All linker ranges (J19: membership of k-mers in the linkers' set)."""
    words = P.packed_words(LINKERS, 12)

    def ranges(b):
        row, start, stop = P.linker_ranges(b, words, 12)
        lists = [[] for _ in range(b.n)]
        for i, x, y in zip(row.tolist(), start.tolist(), stop.tolist(), strict=True):
            lists[i].append({"start": x, "stop": y})
        return [pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]

    each = P.per_batch(one(spark, d), ranges, "seq", ["name"], "r array<struct<start:bigint,stop:bigint>>")
    return each.select("name", F.explode("r").alias("r")).select("name", "r.start", "r.stop")


@query("poly_trim")
def p15(spark, d):
    return P.per_read(one(spark, d), lambda s: P.trim_poly(s.upper(), 0, len(s)), ["seq"], ["name"], "start bigint, stop bigint")


@query("simple_score_plain", f"""{ONE}, t AS (SELECT name, substr(u, p, 3) AS w, length(u) - 2 AS n FROM (SELECT name, upper(seq) AS u, unnest(range(1, length(seq) - 1)) AS p FROM one)),
c AS (SELECT name, w, n, count(*) AS c FROM t WHERE regexp_full_match(w, '[ACGT]{{3}}') GROUP BY ALL), m AS (SELECT name, any_value(n) AS n, count(*) FILTER (c > 1) AS k, coalesce(sum(c * (c - 1)) FILTER (c > 1), 0) AS s FROM c GROUP BY name)
SELECT name, round(k * s / n / (n - k), 9) AS score FROM m WHERE k <= 2 AND n > k""")
def p16(spark, d):
    """Reads with at most two repeated triplets, for which the score has no cluster step."""

    def scored(b):
        at = np.flatnonzero(b.valid(3))
        c = np.bincount(b.row[at].astype(np.int64) * 64 + b.packed(3)[at].astype(np.int64), minlength=b.n * 64).reshape(b.n, 64)
        return [np.where(c.any(axis=1), (c > 1).sum(axis=1), -1), np.round(P.simple_scores(b, np.zeros(b.n, np.int64), b.lengths), 9)]

    r = P.per_batch(one(spark, d), scored, "seq", ["name"], "k bigint, score double")
    return r.where("k between 0 and 2 and score < 1").select("name", "score")


@query("simple_scores", f"""{ONE}, {windows_sql(3, "one", canonical=False, name="tw")}, ct AS (SELECT name, kmer, count(*) AS c FROM tw GROUP BY ALL), has AS (SELECT DISTINCT name FROM ct),
mn AS (SELECT name, c, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY name) AS m, max(c) OVER (PARTITION BY name) AS top, sum(c) OVER w - c AS below FROM ct WHERE c > 1 WINDOW w AS (PARTITION BY name ORDER BY c, kmer ROWS UNBOUNDED PRECEDING)),
cu AS (SELECT name, min(r) AS cut FROM mn WHERE m > 2 AND r >= 1 AND (r >= m - 1 OR c - below // greatest(r, 1) >= top - c) GROUP BY name),
sm AS (SELECT name, any_value(m) AS m, sum(c * (c - 1)) AS s, sum(c * (c - 1)) FILTER (r >= cut) AS hs, count(*) FILTER (r >= cut) AS hn, sum(c) FILTER (r >= cut) / count(*) FILTER (r >= cut) - sum(c) FILTER (r < cut) / count(*) FILTER (r < cut) AS apart FROM mn LEFT JOIN cu USING (name) GROUP BY name),
f AS (SELECT one.name, length(seq) - 2 AS n, has.name IS NOT NULL AS holds, CASE WHEN m > 2 AND apart > 10 THEN hn WHEN m > 2 THEN least(m, 4) ELSE coalesce(m, 0) END AS k, CASE WHEN m > 2 AND apart > 10 THEN hs ELSE coalesce(s, 0) END AS s FROM one LEFT JOIN has USING (name) LEFT JOIN sm USING (name))
SELECT name, CASE WHEN holds AND n > k THEN round(k * s / n / (n - k), 9) ELSE 1.0::DOUBLE END AS score FROM f""")
def p16_all(spark, d):
    return P.per_batch(one(spark, d), lambda b: [np.round(P.simple_scores(b, np.zeros(b.n, np.int64), b.lengths), 9)], "seq", ["name"], "score double")


@query("i4_prepared_reads")
def i4(spark, d):
    return P.prepare(one(spark, d), LINKERS, 12).select("name", "seq", "status")


@query("w8_target_pieces")
def w8(spark, d):
    return P.split_at_targets(one(spark, d), 30, 60)


@query("f25_mended_qualities")
def f25(spark, d):
    """Quality text whose lines of 24 lost the blank between them, mended."""
    text = F.array_join(F.transform("qual", lambda q, i: F.concat(q.cast("string"), F.when((i + 1) % 24 == 0, "").otherwise(" "))), "")
    return P.per_read(one(spark, d).withColumn("t", text), lambda t: (P.mend_qualities(t),), ["t"], ["name"], "qual array<int>").select("name", F.size("qual").alias("n"))


@query("i1_repaired_reads")
def i1(spark, d):
    """Reads repaired from the reads that pair_match matches them to, in either order of a pair, by their alignments."""
    from readloom.functions.reads import bare_name
    from readloom.operators.overlap import aligned_pairs

    r = one(spark, d).where("seq <> ''")
    m = table(spark, d, "pair_match").select(bare_name(F.col("read1")).alias("a"), bare_name(F.col("read2")).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = m.join(r.select(F.col("name").alias("a"), F.col("seq").alias("a_seq")), "a").join(r.select(F.col("name").alias("b"), F.col("seq").alias("b_seq")), "b")
    return X.repair(r.select(F.col("name").alias("query_id"), "seq", "qual"), aligned_pairs(pairs), 2, 2).select("query_id", "seq", "n_changes", "n_confirmed", "aborted")


@query("pair_insert_matches")
def p18(spark, d):
    p = psl(spark, d).where("q_size > 110 and t_size > 110")
    b = p.withColumns({"q_name": F.concat("q_name", F.lit("-40")), "t_name": F.concat("t_name", F.lit("-42")), "n_count": F.lit(48), "strand": F.lit("+"), "matches": F.col("q_size")})
    b = b.withColumns({"block_sizes": F.expr("array(q_start + 25, 15)"), "q_starts": F.expr("array(40 - q_start - 25, 90)"), "t_starts": F.expr("array(42 - q_start - 25, 92)")})
    return A.pair_matches(b, 0.5, 10).groupBy("gap", "flag").agg(F.count("*").alias("n"))


@query("pair_insert_blocks", f"""WITH {PSL}, b AS (SELECT match_id, q_start + 20 AS qs, t_start + 22 AS ts, 12 + gap AS n, gap FROM psl JOIN pm USING (match_id))
SELECT match_id FROM b WHERE (qs < 40 AND qs + n > 40 - 10 - 1 AND 90 + n > 88) AND (ts < 42 AND ts + n > 42 - 10 - 1)""")
def p18b(spark, d):
    n = F.col("q_gap_count") + 12
    b = psl(spark, d).withColumns({"q_name": F.concat("q_name", F.lit("-40")), "t_name": F.concat("t_name", F.lit("-42")), "strand": F.lit("+"), "block_sizes": F.array(n, n), "q_starts": F.array(F.col("q_start") + 20, F.lit(90)), "t_starts": F.array(F.col("t_start") + 22, F.lit(92))})
    return A.spans_insert(b, 10).select("match_id")


@query("f8_prep_names", f"""WITH {READS}, n AS (SELECT file, read_idx, name || ' ' || coalesce(comment, '') AS h FROM reads),
m AS (SELECT file, read_idx, split_part(h, ' ', 1) AS w, coalesce(nullif(regexp_extract(rtrim(h, ' '), '/([12])$', 1), ''), nullif(regexp_extract(h, '^\\S+ ([12]):', 1), ''), nullif(regexp_extract(rtrim(h, ' '), ':([12])$', 1), '')) AS mate FROM n)
SELECT file, read_idx, CASE WHEN mate IS NOT NULL THEN translate(regexp_replace(regexp_replace(w, '/[12]$', ''), ':[12]$', ''), ':#-', '___') || '/' || mate END AS name FROM m""")
def f8(spark, d):
    h = F.rtrim(F.concat("name", F.lit(" "), F.coalesce("comment", F.lit(""))))
    return reads(spark, d).select("file", "read_idx", N.prep_name(h).alias("name"))


@query("f12_directions", f"""WITH {READS} SELECT file, read_idx, CASE WHEN regexp_matches(name, '/[12]$') THEN 1 WHEN regexp_matches(name, '-R[12]$') THEN 2 WHEN regexp_matches(name, '\\.[FR]$') THEN 3 WHEN regexp_matches(name, '\\.[xy]\\d+$') THEN 4 ELSE 0 END AS library_hint,
CASE WHEN regexp_matches(name, '(/1|-R1|\\.F|\\.x\\d+)$') THEN 'F' WHEN regexp_matches(name, '(/2|-R2|\\.R|\\.y\\d+)$') THEN 'R' ELSE '' END AS direction, regexp_replace(name, '(/[12]|-R[12]|\\.[FR]|\\.[xy]\\d+)$', '') AS pair_key FROM reads""")
def f12(spark, d):
    return reads(spark, d).withColumn("p", N.direction_hint(F.col("name"))).select("file", "read_idx", "p.library_hint", "p.direction", "p.pair_key")


@query("f17_joined_n_splits", f"""WITH {READS}, o AS (SELECT file, read_idx, name, seq, row_number() OVER (PARTITION BY file ORDER BY read_idx) - 1 AS i FROM reads), g AS (SELECT *, i // 3 AS g FROM o)
SELECT file, min(read_idx) AS read_idx, arg_min(name, read_idx) AS name, string_agg(CASE WHEN i % 3 > 0 THEN 'NNNNN' ELSE '' END || seq, '' ORDER BY read_idx) AS seq FROM g GROUP BY file, g""")
def f17(spark, d):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("file").orderBy("read_idx")) - 1
    r = one_qual(reads(spark, d)).withColumn("i", i).withColumn("name", F.when(F.col("i") % 3 > 0, "n1-2:3.5.0").otherwise(F.col("name")))
    return N.joined_n_splits(r.drop("i")).select("file", "read_idx", "name", "seq")


def one_qual(r):
    from readloom.functions.dna import full_quality

    return r.withColumn("qual", full_quality(F.col("seq"), F.col("qual"), 20))


@query("f20_suffixed_sizes", "SELECT line_id, (line_id % 50) * 1024 AS n FROM match_line")
def f20(spark, d):
    i = F.col("line_id")
    return table(spark, d, "match_line").select("line_id", N.with_suffix(F.concat((i % 50).cast("string"), F.lit("k"))).alias("n"))


@query("f21_thousands", "SELECT line_id, format('{:,}', line_id * 12345) AS n FROM match_line")
def f21(spark, d):
    return table(spark, d, "match_line").select("line_id", N.thousands(F.col("line_id") * 12345).alias("n"))


@query("f26_pretty_scale", "SELECT file, round(count(*) / 3000000000 * power(10, greatest(0, ceil(-log10(max(count(*) / 3000000000) OVER ()) - 1))), 9) AS x FROM match_line GROUP BY file")
def f26(spark, d):
    g = table(spark, d, "match_line").groupBy("file").agg((F.count("*") / 3_000_000_000).alias("x"))
    return N.pretty_scale(g, ["x"]).select("file", F.round("x", 9).alias("x"))


def _streamed(spark, d, name, make):
    """A stream over the reads' table, run until all of it is in; each batch writes the result so far as a table in the shared folder."""
    from readloom.session import shared_folder
    import uuid

    t = table(spark, d, "raw_read")
    source = spark.readStream.schema(t.schema).parquet(f"{d}/raw_read.parquet*")
    base = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex[:8]}"
    result = make(source)
    q = result.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/result")).option("checkpointLocation", f"{base}/checkpoint").start()
    q.processAllAvailable()
    q.stop()
    return spark.read.schema(result.schema).parquet(f"{base}/result")


@query("st_running_counts", "WITH w AS (SELECT substr(upper(seq), p, 6) AS w FROM (SELECT seq, unnest(range(1, length(seq) - 4)) AS p FROM raw_read)) SELECT least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer, count(*) AS cnt FROM w WHERE regexp_full_match(w, '[ACGT]{6}') GROUP BY 1")
def st_counts(spark, d):
    from readloom.streaming.reads import running_counts

    return _streamed(spark, d, "counts", lambda s: running_counts(s, 6))


@query("st_reads_per_window", "SELECT date_trunc('hour', loaded_at AT TIME ZONE 'UTC') AS start, file, count(*) AS n_reads, sum(length(seq))::BIGINT AS n_bases FROM raw_read GROUP BY ALL")
def st_windows(spark, d):
    from readloom.streaming.reads import reads_per_window

    s = _streamed(spark, d, "windows", lambda s: reads_per_window(s, "loaded_at"))
    return s.withColumn("start", F.col("start").cast("timestamp_ntz"))
