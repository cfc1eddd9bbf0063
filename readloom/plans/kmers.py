"""k-mer counts, histograms and set algebra over the reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.operators import kmers as K
from readloom.plans.sqlkit import READS, counts_sql, reads, windows_sql
from readloom.session import table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# canonical 12-mer counts of the reads by library: reads of .fasta and of .fastq files, and of read ids by remainder are the references
REFS = "CASE WHEN file LIKE '%.fasta' THEN 'fasta' WHEN file LIKE 'lib4%' THEN 'lib4' WHEN file LIKE 'lib8%' THEN 'lib8' ELSE 'other' END"
REF_NAMES = ["fasta", "lib4", "lib8", "other"]
LISTS = """lists AS (SELECT DISTINCT CASE WHEN buffer_id < 4 THEN 1 WHEN buffer_id < 8 THEN 2 ELSE 3 END AS list_id,
  regexp_extract(read_name, '^\\s*[>@]?([^\\s]*)', 1) AS name FROM thread_output)"""


def ref_reads(spark, d):
    f = F.col("file")
    ref = F.when(f.like("%.fasta"), 0).when(f.like("lib4%"), 1).when(f.like("lib8%"), 2).otherwise(3)
    return reads(spark, d).withColumn("tag", ref)


def ref_counts(spark, d, k=12):
    """(ref, kmer, cnt) with kmer as keys."""
    names = F.array(*[F.lit(x) for x in REF_NAMES])
    return K.counts(ref_reads(spark, d), k, F.col("tag"), keys=True).select(names[F.col("tag").cast("int")].alias("ref"), "kmer", "cnt")


def lists(spark, d):
    from readloom.functions.reads import bare_name

    i = F.when(F.col("buffer_id") < 4, 1).when(F.col("buffer_id") < 8, 2).otherwise(3)
    return table(spark, d, "thread_output").select(i.alias("list_id"), bare_name(F.col("read_name")).alias("name")).distinct()


def refs_sql(k=12):
    return f"WITH {READS}, rr AS (SELECT *, {REFS} AS ref FROM reads), {windows_sql(k, 'rr', 'ref')}, rc AS (SELECT ref, kmer, count(*) AS cnt FROM win GROUP BY ALL)"


@query("a1_kmer_counts", f"WITH {READS}, {counts_sql(16)} SELECT kmer, cnt FROM kc WHERE cnt >= 3")
def a1(spark, d):
    return K.counts(reads(spark, d), 16).where("cnt >= 3")


@query("a1_kmer_counts_long", f"WITH {READS}, {counts_sql(40)} SELECT kmer, cnt FROM kc WHERE cnt >= 2")
def a1_long(spark, d):
    return K.counts(reads(spark, d), 40).where("cnt >= 2")


@query("w1_kmer_windows", f"WITH {READS}, {windows_sql(24)} SELECT name, count(*) AS n, min(pos) AS first_pos, max(kmer) AS last_kmer FROM win GROUP BY name")
def w1(spark, d):
    return K.windows(reads(spark, d), 24, ["name"]).groupBy("name").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("kmer").alias("last_kmer"))


@query("a2_list_counts_all", f"WITH {READS}, {LISTS}, t AS (SELECT seq, coalesce(list_id, 0) AS list_id FROM reads LEFT JOIN lists USING (name)), {windows_sql(10, 't', 'list_id')} SELECT list_id, kmer, count(*) AS cnt FROM win GROUP BY ALL HAVING count(*) > 5")
def a2_all(spark, d):
    return K.list_counts(reads(spark, d), 10, lists(spark, d), False).where("cnt > 5")


@query("a2_list_counts_first", f"WITH {READS}, {LISTS}, f AS (SELECT name, min(list_id) AS list_id FROM lists GROUP BY name), t AS (SELECT seq, coalesce(list_id, 0) AS list_id FROM reads LEFT JOIN f USING (name)), {windows_sql(10, 't', 'list_id')} SELECT list_id, kmer, count(*) AS cnt FROM win GROUP BY ALL HAVING count(*) > 5")
def a2_first(spark, d):
    return K.list_counts(reads(spark, d), 10, lists(spark, d), True).where("cnt > 5")


HP = """x AS (SELECT upper(seq) AS u FROM reads),
b AS (SELECT u, unnest(regexp_extract_all(u, '[ACGT]+')) AS s, generate_subscripts(regexp_extract_all(u, '[ACGT]+'), 1) AS i, len(regexp_extract_all(u, '[ACGT]+')) AS m FROM x),
o AS (SELECT s, i = m AND regexp_matches(u, '[ACGT]$') AS cut FROM b UNION ALL SELECT reverse(translate(s, 'ACGT', 'TGCA')), i = 1 AND regexp_matches(u, '^[ACGT]') FROM b),
n AS (SELECT row_number() OVER () AS id, s, cut FROM o),
c AS (SELECT id, s, cut, p, substr(s, p, 1) AS base FROM (SELECT id, s, cut, unnest(range(1, length(s) + 1)) AS p FROM n)),
e AS (SELECT *, CASE WHEN p = 1 OR base <> substr(s, p - 1, 1) THEN 1 ELSE 0 END AS new FROM c),
g AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY p) AS r FROM e),
q AS (SELECT id, any_value(s) AS s, any_value(cut) AS cut, r, any_value(base) AS base, min(p) AS p0, count(*) AS len FROM g GROUP BY id, r),
hp AS (SELECT substr(s, p0 - 8, 8) AS kmer, base, least(len, 16) AS run, count(*) AS cnt FROM q WHERE p0 > 8 AND NOT (cut AND p0 + len - 1 = length(s)) GROUP BY ALL)"""


@query("a3_homopolymer_kmers", f"WITH {READS}, {HP} SELECT kmer, base, run::INT AS run, cnt FROM hp")
def a3(spark, d):
    return K.homopolymer_windows(reads(spark, d), 8)


@query("a8_homopolymer_histogram", f"WITH {READS}, {HP}, h AS (SELECT run, sum(cnt)::BIGINT AS n FROM hp GROUP BY run) SELECT run::INT AS run, n, round(100.0 * n / sum(n) OVER (), 4) AS pct FROM h")
def a8(spark, d):
    return K.homopolymer_histogram(K.homopolymer_windows(reads(spark, d), 8))


@query("a8_homopolymer_listing", f"WITH {READS}, {HP} SELECT kmer, base, run::INT AS run, round(100.0 * cnt / sum(cnt) OVER (PARTITION BY kmer, base), 4) AS pct FROM hp")
def a8_listing(spark, d):
    return K.homopolymer_listing(K.homopolymer_windows(reads(spark, d), 8))


HIST = """h AS (SELECT cnt AS freq, count(*) AS n, 100.0 * sum(length(kmer) - length(translate(kmer, 'GC', ''))) / sum(length(kmer)) AS gc FROM kc GROUP BY cnt),
o AS (SELECT *, CASE WHEN freq > 1 THEN freq * n END AS part FROM h)
SELECT freq, n, round(100.0 * part / sum(part) OVER (), 4) AS pct, round(CASE WHEN freq > 1 THEN 100.0 * sum(part) OVER (ORDER BY freq ROWS UNBOUNDED PRECEDING) / sum(part) OVER () END, 4) AS cum_pct"""


@query("a4_kmer_histogram", f"WITH {READS}, {counts_sql(12)}, {HIST} FROM o")
def a4(spark, d):
    return K.histogram(K.counts(reads(spark, d), 12))


@query("a4_kmer_histogram_gc", f"WITH {READS}, {counts_sql(8)}, {HIST}, round(gc, 4) AS gc_pct FROM o")
def a4_gc(spark, d):
    return K.histogram(K.counts(reads(spark, d), 8), gc=True)


WIDE = f"""WITH {READS}, {LISTS}, t AS (SELECT seq, coalesce(list_id, 0) AS list_id FROM reads LEFT JOIN lists USING (name)), {windows_sql(10, 't', 'list_id')},
w AS (SELECT kmer, count(*) AS total, count(*) FILTER (list_id = 0) AS x0, count(*) FILTER (list_id = 1) AS x1, count(*) FILTER (list_id = 2) AS x2, count(*) FILTER (list_id = 3) AS x3 FROM win GROUP BY kmer)"""


@query("a5_subtractive_histogram", f"""{WIDE} SELECT l.list_id, total AS freq, sum(l.m)::BIGINT AS n FROM (SELECT total, unnest([{{'list_id': 1, 'm': total - x1}}, {{'list_id': 2, 'm': total - x1 - x2}}, {{'list_id': 3, 'm': total - x1 - x2 - x3}}]) AS l FROM w WHERE total <> x1) GROUP BY ALL""")
def a5(spark, d):
    return K.subtractive_histogram(K.list_counts(reads(spark, d), 10, lists(spark, d), False), 3)


@query("a6_comparative_histogram", f"""{WIDE} SELECT l.list_id, x0 AS freq, sum(l.m)::BIGINT AS n FROM (SELECT x0, unnest([{{'list_id': 1, 'm': x1}}, {{'list_id': 2, 'm': x2}}, {{'list_id': 3, 'm': x3}}]) AS l FROM w) WHERE l.m <> 0 GROUP BY ALL""")
def a6(spark, d):
    return K.comparative_histogram(K.list_counts(reads(spark, d), 10, lists(spark, d), False), 3)


@query("a7_frequency_listing", f"WITH {READS}, {counts_sql(12)} SELECT DISTINCT unnest([kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))]) AS kmer, cnt FROM kc WHERE cnt BETWEEN 4 AND 40")
def a7(spark, d):
    return K.listing(K.counts(reads(spark, d), 12), 4, 40)


@query("a9_windowed_unique", f"""WITH {READS}, one AS (SELECT name, any_value(seq ORDER BY file) AS seq FROM reads GROUP BY name),
c AS (SELECT name, seq, unnest(range(1, length(seq) + 1)) AS p FROM one), g AS (SELECT name, p, substr(seq, p, 1) AS b FROM c WHERE substr(seq, p, 1) SIMILAR TO '[ACGTacgt]'),
i AS (SELECT *, p - row_number() OVER (PARTITION BY name ORDER BY p) AS g FROM g), r AS (SELECT name, min(p) - 1 AS start, upper(string_agg(b, '' ORDER BY p)) AS seq FROM i GROUP BY name, g HAVING count(*) >= 10),
{windows_sql(10, 'r', 'name, start')}
SELECT kmer, count(*) AS cnt FROM win GROUP BY kmer HAVING count(DISTINCT (name, start)) = 1 AND max(pos) - min(pos) < 30 AND count(*) <= 3""")
def a9(spark, d):
    one = reads(spark, d).groupBy("name").agg(F.min_by("seq", "file").alias("seq"))
    return K.windowed_unique(one, 10, 30, 3)


@query("a10_merge_counts", f"{refs_sql()} SELECT kmer, sum(cnt)::BIGINT AS cnt FROM rc WHERE ref IN ('fasta', 'lib4') GROUP BY kmer HAVING sum(cnt) > 2")
def a10(spark, d):
    c = ref_counts(spark, d)
    return K.spell(K.merge_counts(*[c.where(F.col("ref") == r).select("kmer", "cnt") for r in ("fasta", "lib4")]).where("cnt > 2"), 12)


COMBINED = f"""{refs_sql()}, cb AS (SELECT kmer, CASE WHEN max(cnt) > 50 THEN 0 ELSE least(254, count(*) FILTER (cnt BETWEEN 2 AND 50)) END AS n_refs, max(cnt) > 50 AS invalid FROM rc GROUP BY kmer HAVING max(cnt) >= 2)"""


def combined(spark, d):
    return K.combine_references(ref_counts(spark, d), 2, 50)


@query("a11_combine_references", f"{COMBINED} SELECT kmer, n_refs, invalid FROM cb")
def a11(spark, d):
    return K.spell(combined(spark, d), 12)


@query("a12_screen_by_library", f"{COMBINED}, lb AS (SELECT kmer, cnt AS lib FROM rc WHERE ref = 'other') SELECT kmer, CASE WHEN invalid OR lib NOT BETWEEN 2 AND 30 THEN 0 ELSE n_refs END AS value, invalid OR lib NOT BETWEEN 2 AND 30 AS invalid FROM cb JOIN lb USING (kmer)")
def a12(spark, d):
    return K.spell(K.screen_by_library(combined(spark, d), ref_counts(spark, d).where("ref = 'other'"), 2, 30), 12)


@query("a12_screen_keep_library", f"{COMBINED}, lb AS (SELECT kmer, cnt AS lib FROM rc WHERE ref = 'other'), j AS (SELECT kmer, invalid OR coalesce(lib, 0) NOT BETWEEN 2 AND 30 AS bad, coalesce(lib, 0) AS lib FROM cb LEFT JOIN lb USING (kmer)) SELECT kmer, CASE WHEN bad THEN 0 ELSE lib END AS value, bad AS invalid FROM j")
def a12_keep(spark, d):
    return K.spell(K.screen_by_library(combined(spark, d), ref_counts(spark, d).where("ref = 'other'"), 2, 30, keep_library=True), 12)


@query("a13_combined_histogram", f"{COMBINED}, h AS (SELECT n_refs, invalid, count(*) AS n FROM cb GROUP BY ALL) SELECT n_refs, invalid, n, round(100.0 * n / sum(n) OVER (), 4) AS pct FROM h")
def a13(spark, d):
    return K.combined_histogram(combined(spark, d))


@query("a14_prune_counts", f"WITH {READS}, {counts_sql(12)} SELECT kmer, cnt FROM kc WHERE cnt BETWEEN 3 AND 9")
def a14(spark, d):
    return K.prune(K.counts(reads(spark, d), 12), 3, 9)


IDENT = """s AS (SELECT ref, kmer FROM rc WHERE cnt >= 1), keep AS (SELECT kmer FROM s GROUP BY kmer HAVING count(DISTINCT ref) <= 3), u AS (SELECT * FROM s WHERE kmer IN (SELECT kmer FROM keep))"""


@query("a15_shared_identity", f"{refs_sql()}, n AS (SELECT ref AS ref_a, count(*) AS size FROM rc GROUP BY ref), p AS (SELECT a.ref AS ref_a, b.ref AS ref_b, count(*) AS shared FROM rc a JOIN rc b USING (kmer) WHERE a.ref <> b.ref GROUP BY ALL) SELECT ref_a, ref_b, shared, round(shared / size, 6) AS identity FROM p JOIN n USING (ref_a)")
def a15(spark, d):
    return K.shared_identity(ref_counts(spark, d))


@query("a15_identity_after_subtraction", f"{refs_sql()}, {IDENT}, n AS (SELECT ref AS ref_a, count(*) AS size FROM s GROUP BY ref), p AS (SELECT a.ref AS ref_a, b.ref AS ref_b, count(*) AS shared FROM u a JOIN u b USING (kmer) WHERE a.ref <> b.ref GROUP BY ALL) SELECT ref_a, ref_b, shared, round(shared / size, 6) AS identity FROM p JOIN n USING (ref_a)")
def a15_u(spark, d):
    return K.shared_identity(ref_counts(spark, d), most_refs=3, keep_denominator=True)


@query("a16_presence_string", f"{refs_sql()} SELECT kmer, concat(coalesce(max(cnt) FILTER (ref = 'fasta'), 0), coalesce(max(cnt) FILTER (ref = 'lib4'), 0), coalesce(max(cnt) FILTER (ref = 'lib8'), 0), coalesce(max(cnt) FILTER (ref = 'other'), 0)) AS presence FROM rc GROUP BY kmer HAVING bool_or(ref = 'lib4')")
def a16(spark, d):
    return K.spell(K.presence_string(ref_counts(spark, d), "lib4", REF_NAMES), 12)


@query("u2_drop_shared", f"{refs_sql()}, w AS (SELECT kmer FROM rc GROUP BY kmer HAVING count(*) > 2) SELECT ref, count(*) AS n, sum(cnt)::BIGINT AS total FROM rc WHERE kmer NOT IN (SELECT kmer FROM w) GROUP BY ref")
def u2(spark, d):
    return K.drop_shared(ref_counts(spark, d), 2).groupBy("ref").agg(F.count("*").alias("n"), F.sum("cnt").alias("total"))


@query("u3_intersection", f"{refs_sql()} SELECT kmer FROM rc WHERE ref = 'lib4' INTERSECT SELECT kmer FROM rc WHERE ref = 'lib8'")
def u3(spark, d):
    c = ref_counts(spark, d)
    return K.spell(c.where("ref = 'lib4'").select("kmer").intersect(c.where("ref = 'lib8'").select("kmer")), 12)


@query("u4_presence_counts", f"{refs_sql()} SELECT n_refs, count(*) AS n FROM (SELECT kmer, count(*) AS n_refs FROM rc GROUP BY kmer) GROUP BY n_refs")
def u4(spark, d):
    return K.presence_counts(ref_counts(spark, d)).groupBy("n_refs").agg(F.count("*").alias("n"))


@query("j2_library_counts_of_reference", f"{refs_sql()} SELECT kmer, coalesce(max(cnt) FILTER (ref = 'other'), 0) AS lib FROM rc WHERE ref IN ('lib4', 'other') GROUP BY kmer HAVING bool_or(ref = 'lib4')")
def j2(spark, d):
    c = ref_counts(spark, d)
    lib = c.where("ref = 'other'").select("kmer", F.col("cnt").alias("lib"))
    return K.spell(c.where("ref = 'lib4'").select("kmer").join(lib, "kmer", "left").select("kmer", F.coalesce("lib", F.lit(0)).cast("bigint").alias("lib")), 12)


@query("j3_few_reference_kmers", f"{COMBINED} SELECT kmer, n_refs FROM rc JOIN cb USING (kmer) WHERE ref = 'lib8' AND NOT invalid AND n_refs BETWEEN 1 AND 2")
def j3(spark, d):
    return K.spell(K.targets_in_few_references(ref_counts(spark, d).where("ref = 'lib8'"), combined(spark, d), 2), 12)


@query("a30_postings", f"WITH {READS}, {windows_sql(14, keep='read_id')} SELECT kmer, read_id, count(*) AS n FROM win GROUP BY ALL HAVING count(*) > 1")
def a30(spark, d):
    return K.postings(reads(spark, d), 14).where("n > 1")


@query("a30_postings_all", f"WITH {READS}, {windows_sql(14, keep='read_id')} SELECT kmer, read_id, count(*) AS n FROM win GROUP BY ALL")
def a30_all(spark, d):
    return K.postings(reads(spark, d), 14)


@query("a31_postings_histogram", f"WITH {READS}, {counts_sql(14)} SELECT cnt AS size, count(*) AS n_kmers FROM kc GROUP BY cnt")
def a31(spark, d):
    return K.postings_histogram(K.postings(reads(spark, d), 14))
