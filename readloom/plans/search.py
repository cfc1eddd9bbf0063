"""Search, loci, pairs, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.functions import names as N
from readloom.operators import kmers as K
from readloom.operators import route as T
from readloom.operators import search as S
from readloom.plans.masking import ONE, one
from readloom.plans.sqlkit import READS, reads, windows_sql
from readloom.session import table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# every read whose id is divisible by 100 is a query, against all reads
QUERY = "qs AS (SELECT read_id AS query, seq FROM reads WHERE read_id % 100 = 0)"


def queries_of(r):
    return r.where("read_id % 100 = 0").select(F.col("read_id").alias("query"), "seq")


SEARCH = f"""WITH {READS}, {QUERY}, {windows_sql(14, keep='read_id', name='rw')}, ps AS (SELECT kmer, read_id, count(*) AS n FROM rw GROUP BY ALL),
{windows_sql(14, 'qs', 'query', name='qw')}, q AS (SELECT query, kmer, count(*) AS m FROM qw GROUP BY ALL), qn AS (SELECT query, count(*) AS q_kmers FROM qw GROUP BY query),
rn AS (SELECT read_id, sum(n) AS kmers FROM ps GROUP BY read_id), wide AS (SELECT kmer FROM ps GROUP BY kmer HAVING sum(n) > 60),
h AS (SELECT query, read_id, sum(m * n)::BIGINT AS hits FROM q JOIN ps USING (kmer) WHERE kmer NOT IN (SELECT kmer FROM wide) GROUP BY ALL)"""


@query("q1_search", f"{SEARCH}, v AS (SELECT query, read_id, hits, round(hits / q_kmers, 6) AS value FROM h JOIN qn USING (query)) SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, read_id) AS rank_no FROM v WHERE value >= 0.1")
def q1(spark, d):
    r = reads(spark, d)
    return S.ReadIndex.build(r, 14).set(most_hits=60, least_value=0.1).ranked(queries_of(r))


@query("j4_search_by_read", f"{SEARCH} SELECT query, read_id, hits, round(hits / kmers, 6) AS value FROM h JOIN rn USING (read_id)")
def j4(spark, d):
    r = reads(spark, d)
    return S.ReadIndex.build(r, 14).set(most_hits=60, by="read").search(queries_of(r))


# the same without a cap on the occurrences of a k-mer
WHOLE = f"""WITH {READS}, {QUERY}, {windows_sql(14, keep='read_id', name='rw')}, ps AS (SELECT kmer, read_id, count(*) AS n FROM rw GROUP BY ALL),
{windows_sql(14, 'qs', 'query', name='qw')}, q AS (SELECT query, kmer, count(*) AS m FROM qw GROUP BY ALL), qn AS (SELECT query, count(*) AS q_kmers FROM qw GROUP BY query),
rn AS (SELECT read_id, sum(n) AS kmers FROM ps GROUP BY read_id), h AS (SELECT query, read_id, sum(m * n)::BIGINT AS hits FROM q JOIN ps USING (kmer) GROUP BY ALL)"""


@query("q1_search_all", f"{WHOLE}, v AS (SELECT query, read_id, hits, round(hits / q_kmers, 6) AS value FROM h JOIN qn USING (query)) SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, read_id) AS rank_no FROM v WHERE value >= 0.1")
def q1_all(spark, d):
    r = reads(spark, d)
    return S.ReadIndex.build(r, 14).set(least_value=0.1).ranked(queries_of(r))


@query("j4_search_by_read_all", f"{WHOLE} SELECT query, read_id, hits, round(hits / kmers, 6) AS value FROM h JOIN rn USING (read_id)")
def j4_all(spark, d):
    r = reads(spark, d)
    return S.ReadIndex.build(r, 14).set(by="read").search(queries_of(r))


# fasta reads are the reference, the others the target
HITS = f"""WITH {READS}, {windows_sql(16, "(SELECT * FROM reads WHERE file LIKE '%.fasta')", 'file, read_idx, name', name='fw')},
fp AS (SELECT kmer, min(struct_pack(file := file, read_idx := read_idx, pos := pos, name := name)) AS x FROM fw GROUP BY kmer),
{windows_sql(16, "(SELECT * FROM reads WHERE file NOT LIKE '%.fasta')", 'name', name='tw')},
ht AS (SELECT x.file AS file, x.read_idx AS read_idx, x.name AS name, x.pos AS pos FROM fp WHERE kmer IN (SELECT kmer FROM tw))"""


def hit_positions(spark, d):
    r = reads(spark, d)
    return S.hits(r.where("file like '%.fasta'"), r.where("file not like '%.fasta'"), 16)


@query("j5_hit_positions", f"{HITS} SELECT file, read_idx, name, pos FROM ht")
def j5(spark, d):
    return S.located(*hit_positions(spark, d), "file", "read_idx", "name")


def merge_sql(gap: int) -> str:
    return f"""{HITS}, n AS (SELECT *, CASE WHEN pos - lag(pos) OVER w > {gap} OR lag(pos) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM ht WINDOW w AS (PARTITION BY file, read_idx ORDER BY pos)),
g AS (SELECT *, sum(new) OVER (PARTITION BY file, read_idx ORDER BY pos) AS g FROM n) SELECT file, read_idx, min(pos) AS start, max(pos) + 16 AS stop FROM g GROUP BY file, read_idx, g"""


@query("w6_merged_hits", merge_sql(1))
def w6(spark, d):
    found, r = hit_positions(spark, d)
    return S.located(S.merge_hits(found, 16), r, "file", "read_idx")


@query("w6_merged_hits_touching", merge_sql(16))
def w6_touch(spark, d):
    found, r = hit_positions(spark, d)
    return S.located(S.merge_hits(found, 16, touching=True), r, "file", "read_idx")


@query("a14_squashed_reads", merge_sql(16).replace("SELECT file, read_idx, min(pos) AS start, max(pos) + 16 AS stop FROM g GROUP BY file, read_idx, g", "m AS (SELECT file, read_idx, any_value(name) AS name, min(pos) AS start, max(pos) + 16 AS stop FROM g GROUP BY file, read_idx, g) SELECT m.*, substr(r.seq, start + 1, stop - start) AS seq, (sum(stop - start) OVER (ORDER BY m.file, m.read_idx, start) - (stop - start))::BIGINT AS offset FROM m JOIN reads r ON r.file = m.file AND r.read_idx = m.read_idx").replace("AS stop FROM g GROUP BY file, read_idx, g) SELECT", "AS stop FROM g GROUP BY file, read_idx, g) SELECT").replace("g AS (SELECT *, sum(new) OVER (PARTITION BY file, read_idx ORDER BY pos) AS g FROM n) m AS", "g AS (SELECT *, sum(new) OVER (PARTITION BY file, read_idx ORDER BY pos) AS g FROM n), m AS"))
def a14_squash(spark, d):
    return S.squashed_reads(*hit_positions(spark, d), 16)


@query("j17_offsets_to_reads", f"""WITH {READS}, r AS (SELECT file, read_idx, name, length(seq) AS n FROM reads WHERE seq <> ''), l AS (SELECT *, sum(n) OVER (ORDER BY file, read_idx) - n AS start FROM r), o AS (SELECT match_id, match_id * 37 AS at FROM (SELECT DISTINCT match_id FROM pair_match))
SELECT match_id, o.at AS offset, file, read_idx, name, (o.at - start)::BIGINT AS pos FROM o ASOF JOIN l ON o.at >= l.start WHERE o.at < start + n""")
def j17(spark, d):
    offsets = table(spark, d, "pair_match").select("match_id").distinct().withColumn("offset", F.col("match_id") * 37)
    return S.offsets_to_reads(offsets, reads(spark, d))


@query("o4_squashed_loci", """WITH one AS (SELECT upper(seq) AS seq, id1 || '_' || id2 AS id, string_agg(DISTINCT parent, '' ORDER BY parent) AS parents FROM loci WHERE seq NOT IN ('NONE', '') GROUP BY ALL)
SELECT seq, string_agg(id || '_' || parents, ';' ORDER BY id || '_' || parents) AS locus FROM one GROUP BY seq""")
def o4(spark, d):
    return S.squashed_loci(table(spark, d, "loci"))


LOCI = f"""{ONE}, {windows_sql(32, 'one', 'name', canonical=False, name='lw')}, ls AS (SELECT DISTINCT seq FROM loci WHERE length(seq) = 32),
sd AS (SELECT seq AS kmer, seq, '+' AS strand FROM ls UNION ALL SELECT reverse(translate(seq, 'ACGT', 'TGCA')), seq, '-' FROM ls WHERE reverse(translate(seq, 'ACGT', 'TGCA')) <> seq),
fl AS (SELECT name, pos, strand, sd.seq AS locus_seq FROM lw JOIN sd USING (kmer))"""


@query("j7_find_loci", f"{LOCI} SELECT name, pos, strand, locus_seq FROM fl")
def j7(spark, d):
    return S.find_loci(one(spark, d), table(spark, d, "loci"), ["name"])


@query("r8_reads_by_locus", f"{LOCI}, dn AS (SELECT locus_seq, name, (row_number() OVER (PARTITION BY locus_seq ORDER BY name) - 1) // 20 AS part FROM (SELECT DISTINCT locus_seq, name FROM fl)) SELECT locus_seq, part, count(*) AS n_reads, string_agg(name, ' ' ORDER BY name) AS names FROM dn GROUP BY ALL")
def r8(spark, d):
    f = S.find_loci(one(spark, d), table(spark, d, "loci"), ["name"])
    return S.reads_by_locus(f, 20)


# reads 2i and 2i+1 are mates
PAIRS = f"""WITH {READS}, pr AS (SELECT (read_id // 2)::VARCHAR AS base, min(seq) FILTER (read_id % 2 = 0) AS seq1, min(seq) FILTER (read_id % 2 = 1) AS seq2 FROM reads GROUP BY 1 HAVING count(*) FILTER (read_id % 2 = 0) > 0 AND count(*) FILTER (read_id % 2 = 1) > 0)"""


def pairs(spark, d):
    i = F.col("read_id")
    return T.mates(reads(spark, d), F.floor(i / 2).cast("string"), (i % 2 + 1).cast("int"), keep=("seq",))


@query("j8_mates", f"{PAIRS} SELECT base, seq1, seq2 FROM pr")
def j8(spark, d):
    return pairs(spark, d)


@query("w11_pair_duplicates", f"""{PAIRS}, k AS (SELECT base, upper(substr(seq1, 1, 24) || substr(seq2, 1, 24)) AS u, length(seq1) >= 24 AND length(seq2) >= 24 AS ok FROM pr),
c AS (SELECT base, CASE WHEN ok AND regexp_full_match(u, '[ACGT]*') THEN least(u, reverse(translate(u, 'ACGT', 'TGCA'))) END AS k FROM k)
SELECT base, CASE WHEN k IS NULL THEN 'bad' WHEN base = min(base) OVER (PARTITION BY k) THEN 'unique' ELSE 'dup' END AS status FROM c""")
def w11(spark, d):
    return T.pair_duplicates(pairs(spark, d), 24)


@query("w12_singletons", f"WITH {READS}, b AS (SELECT file, read_idx, name, read_id // 40 AS b FROM reads) SELECT file, read_idx, name FROM b WINDOW w AS (PARTITION BY file ORDER BY read_idx) QUALIFY NOT (b IS NOT DISTINCT FROM lag(b) OVER w OR b IS NOT DISTINCT FROM lead(b) OVER w)")
def w12(spark, d):
    return T.singletons(reads(spark, d), base=F.floor(F.col("read_id") / 40)).select("file", "read_idx", "name")


@query("r6_concatenated_pairs", f"{PAIRS} SELECT base || '-' || length(seq1) AS name, reverse(translate(seq1, 'ACGTacgt', 'TGCAtgca')) || repeat('N', 48) || seq2 AS seq FROM pr WHERE length(seq1) >= 100 AND length(seq2) >= 100")
def r6(spark, d):
    return T.concatenated_pairs(pairs(spark, d), 100)


@query("mended_pairs", f"""{PAIRS}, g AS (SELECT *, length(seq1) >= 140 AS g1, length(seq2) >= 140 AS g2 FROM pr) SELECT base,
CASE WHEN NOT g1 AND g2 THEN reverse(translate(seq2, 'ACGTacgt', 'TGCAtgca')) ELSE seq1 END AS seq1, CASE WHEN g1 AND NOT g2 THEN reverse(translate(seq1, 'ACGTacgt', 'TGCAtgca')) ELSE seq2 END AS seq2 FROM g""")
def p23(spark, d):
    from readloom.operators.reads import mend_pair

    p = pairs(spark, d).withColumns({"good1": F.length("seq1") >= 140, "good2": F.length("seq2") >= 140})
    return mend_pair(p).select("base", "seq1", "seq2")


BARS = [(f"s{i}", a + b, b + a) for i, (a, b) in enumerate([("AC", "GT"), ("GA", "TC"), ("TT", "AG"), ("CA", "CC"), ("GG", "AT")])]
BAR_SQL = "bc AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{a}', '{b}')" for n, a, b in BARS) + ") AS t(name, bc1, bc2))"


def barcodes(spark):
    return spark.createDataFrame(BARS, "name string, bc1 string, bc2 string")


@query("r3_demultiplex_exact", f"{PAIRS}, {BAR_SQL} SELECT base, coalesce(name, 'no_match') AS route FROM pr LEFT JOIN bc ON upper(substr(seq1, 1, 4)) = bc1 AND upper(substr(seq2, 1, 4)) = bc2")
def r3(spark, d):
    return T.demultiplex_exact(pairs(spark, d), barcodes(spark), 4).select("base", "route")


@query("r3_demultiplex_single", f"WITH {READS}, {BAR_SQL}, h AS (SELECT file, read_idx, name AS n, seq FROM reads), m AS (SELECT file, read_idx, n, count(name) AS c, min(name) AS route FROM h LEFT JOIN bc ON regexp_matches(upper(seq), bc1 || '.*' || reverse(translate(bc2, 'ACGT', 'TGCA'))) GROUP BY ALL) SELECT file, read_idx, CASE WHEN c = 0 THEN 'no_match' WHEN c > 1 THEN 'multi_match' ELSE route END AS route FROM m")
def r3_single(spark, d):
    return T.demultiplex_single(reads(spark, d), barcodes(spark)).select("file", "read_idx", "route")


J15 = """, c AS (SELECT base, bc.name, bc1, strpos({s1}, bc1) AS a, strpos({s2}, bc2) AS b FROM pr, bc WHERE strpos({s1}, bc1) > 0)
SELECT pr.base, coalesce(x.route, 'no_match') AS route FROM pr LEFT JOIN (SELECT base, arg_min(CASE WHEN b > 0 THEN name ELSE '-' END, (a, bc1, CASE WHEN b > 0 THEN b ELSE 2147483647 END)) AS r, nullif(r, '-') AS route FROM c {keep} GROUP BY base) x USING (base)"""


@query("j15_pair_head", f"{PAIRS}, {BAR_SQL}" + J15.format(s1="upper(substr(seq1, 1, 10))", s2="upper(substr(seq2, 1, 10))", keep=""))
def j15(spark, d):
    return T.demultiplex_pair(pairs(spark, d), barcodes(spark), 10).select("base", "route")


@query("j15_pair_anywhere", f"{PAIRS}, {BAR_SQL}" + J15.format(s1="upper(seq1)", s2="upper(seq2)", keep="WHERE b > 0"))
def j15_any(spark, d):
    return T.demultiplex_pair(pairs(spark, d), barcodes(spark), None, retry=True).select("base", "route")


@query("s26_used_barcodes", f"{PAIRS}, {BAR_SQL} SELECT DISTINCT name FROM bc WHERE EXISTS (SELECT 1 FROM pr WHERE upper(substr(seq1, 1, 4)) = bc1)")
def s26(spark, d):
    used = pairs(spark, d).select(F.upper(F.substring("seq1", 1, 4)).alias("bc1")).distinct()
    return barcodes(spark).join(used, "bc1", "left_semi").select("name")


LISTED = "ls AS (SELECT CASE WHEN buffer_id < 4 THEN 1 WHEN buffer_id < 8 THEN 2 ELSE 3 END AS list_id, regexp_extract(read_name, '^\\s*[>@]?([^\\s]*)', 1) AS name FROM thread_output)"


@query("r1_route_by_lists", f"WITH {READS}, {LISTED}, f AS (SELECT name, min(list_id) AS list_id FROM ls GROUP BY name), o AS (SELECT name, min(read_idx) AS read_idx FROM reads GROUP BY name) SELECT read_idx, name, list_id FROM o JOIN f USING (name)")
def r1(spark, d):
    from readloom.plans.kmers import lists

    return T.route_by_lists(reads(spark, d), lists(spark, d))


@query("j16_list_flags", f"WITH {READS}, {LISTED}, f AS (SELECT name, bit_or(1 << list_id) AS flags FROM ls GROUP BY name) SELECT file, read_idx, coalesce(flags, 1)::BIGINT AS flags FROM reads LEFT JOIN f USING (name)")
def j16(spark, d):
    from readloom.plans.kmers import lists

    f = lists(spark, d).groupBy("name").agg(F.bit_or(F.expr("shiftleft(1L, list_id)")).alias("flags"))
    return reads(spark, d).join(f, "name", "left").select("file", "read_idx", F.coalesce("flags", F.lit(1)).cast("bigint").alias("flags"))


@query("j11_pattern_lists", f"WITH {READS}, p AS (SELECT * FROM (VALUES (1, '^m9[0-9]+_'), (2, '/1$'), (3, 'P[0-9]+[ab]\\.')) AS t(list_id, pattern)) SELECT list_id, count(*) AS n FROM reads JOIN p ON regexp_matches(name, pattern) GROUP BY list_id")
def j11(spark, d):
    p = spark.createDataFrame([(1, "^m9[0-9]+_"), (2, "/1$"), (3, r"P[0-9]+[ab]\.")], "list_id int, pattern string")
    r = reads(spark, d)
    return r.join(F.broadcast(p), F.expr("name rlike pattern")).groupBy("list_id").agg(F.count("*").alias("n"))


@query("r4_interleaved", "SELECT line_id * 2 AS ord, raw_line AS value FROM match_line UNION ALL SELECT line_id * 2 + 1, reverse(raw_line) FROM match_line")
def r4(spark, d):
    left = table(spark, d, "match_line").select(F.col("line_id").alias("n"), F.col("raw_line").alias("value"))
    return T.interleave(left, left.select("n", F.reverse("value").alias("value")))


@query("r5_even_chunks", "WITH n AS (SELECT match_id, row_number() OVER (ORDER BY match_id) - 1 AS i, count(*) OVER () AS t FROM (SELECT DISTINCT match_id FROM pair_match)) SELECT match_id, CASE WHEN i < (t % 7) * (t // 7 + 1) THEN i // (t // 7 + 1) ELSE t % 7 + (i - (t % 7) * (t // 7 + 1)) // (t // 7) END AS chunk FROM n")
def r5(spark, d):
    return T.even_chunks(table(spark, d, "pair_match").select("match_id").distinct(), "match_id", 7)


@query("r7_packed_files")
def r7(spark, d):
    """Files of reads in four bins of near equal size (one row a file is collected)."""
    sizes = {r.file: r.n for r in reads(spark, d).groupBy("file").agg(F.sum(F.length("seq")).alias("n")).collect()}
    return spark.createDataFrame([(f, i, sizes[f]) for i, b in enumerate(T.pack_files(sizes, 4)) for f in b], "file string, bin int, n_bases bigint")


@query("j18_kmer_set_pairs", f"""WITH {READS}, {windows_sql(16, keep='file', name='sw')}, s AS (SELECT DISTINCT file, kmer FROM sw), n AS (SELECT file AS ref_a, count(*) AS size FROM s GROUP BY file),
p AS (SELECT a.file AS ref_a, b.file AS ref_b, count(*) AS shared FROM s a JOIN s b USING (kmer) WHERE a.file <> b.file GROUP BY ALL) SELECT ref_a, ref_b, shared, round(shared / size, 6) AS identity FROM p JOIN n USING (ref_a)""")
def j18(spark, d):
    return K.shared_identity(K.reference_counts(reads(spark, d), 16, "file"))


@query("f6_bare_names", "SELECT out_id, regexp_extract(read_name, '^\\s*[>@]?([^\\s]*)', 1) AS name, regexp_replace(read_name, '^\\S+\\s+', '') AS rest FROM thread_output")
def f6(spark, d):
    from readloom.functions.reads import bare_name

    return table(spark, d, "thread_output").select("out_id", bare_name(F.col("read_name")).alias("name"), N.without_trace_id(F.col("read_name")).alias("rest"))


@query("f7_short_names", """SELECT file, read_idx, CASE WHEN regexp_matches(name || ' ' || coalesce(comment, ''), '^\\S+ [12]:') THEN translate(name, ':', '_') || '-R' || regexp_extract(name || ' ' || coalesce(comment, ''), '^\\S+ ([12]):', 1) ELSE name || ' ' || coalesce(comment, '') END AS name FROM raw_read""")
def f7(spark, d):
    n = F.concat("name", F.lit(" "), F.coalesce("comment", F.lit("")))
    return table(spark, d, "raw_read").select("file", "read_idx", N.illumina_short(n).alias("name"))


@query("f10_holes", "SELECT read_id, any_value(try_cast(regexp_extract(name, '^[^/]+/(\\d+)(/|$)', 1) AS BIGINT)) AS hole FROM raw_read WHERE name LIKE 'm%' GROUP BY read_id")
def f10(spark, d):
    return table(spark, d, "raw_read").where("name like 'm%'").groupBy("read_id").agg(F.max(N.hole(F.col("name"))).alias("hole"))


@query("f11_parsed_names", f"""WITH {READS} SELECT file, read_idx,
CASE WHEN regexp_matches(name, '^m[^/]+/\\d+/(ccs|\\d+_\\d+)$') THEN 'movie' WHEN regexp_matches(name, '^[A-Za-z0-9]+:\\d+:[A-Za-z0-9]+:\\d+:\\d+:\\d+:\\d+/[12]$') THEN 'illumina'
 WHEN regexp_matches(name, '^[A-Z]{{2}}\\d{{2}}P\\d+[a-z]\\.[FR]$') THEN 'plate' WHEN regexp_matches(name, '^[A-Z]{{2}}\\d{{4}}[0-9A-Z]+\\.[xy]\\d+$') THEN 'trace' ELSE 'other' END AS kind,
CASE WHEN kind = 'other' THEN '' WHEN regexp_matches(name, '(/1|\\.F|\\.x\\d+)$') THEN 'F' WHEN regexp_matches(name, '(/2|\\.R|\\.y\\d+)$') THEN 'R' ELSE '' END AS direction FROM reads""")
def f11(spark, d):
    return reads(spark, d).withColumn("p", N.parsed_name(F.col("name"))).select("file", "read_idx", "p.kind", "p.direction")


@query("f13_libraries", f"WITH {READS} SELECT CASE WHEN regexp_matches(name, '^m\\d+_') THEN regexp_extract(name, '^(m\\d+)_', 1) WHEN regexp_matches(name, '^[A-Za-z0-9]+:\\d+:') THEN regexp_extract(name, '^([A-Za-z0-9]+:\\d+):', 1) WHEN regexp_matches(name, '^[A-Z]{{2}}\\d{{2}}') THEN regexp_extract(name, '^([A-Z]{{2}}\\d{{2}})', 1) END AS library, count(*) AS n FROM reads GROUP BY 1")
def f13(spark, d):
    return reads(spark, d).groupBy(N.library(F.col("name")).alias("library")).agg(F.count("*").alias("n"))


@query("f19_fields", "SELECT line_id, len(list_filter(regexp_split_to_array(raw_line, '\\s+'), lambda x: x <> '')) AS n_words, len(string_split(raw_line, ' ')) AS n_exact FROM match_line WHERE raw_line IS NOT NULL")
def f19(spark, d):
    t = table(spark, d, "match_line").where("raw_line is not null")
    return t.select("line_id", F.size(N.words(F.col("raw_line"))).cast("bigint").alias("n_words"), F.size(N.exact_fields(F.col("raw_line"), " ")).cast("bigint").alias("n_exact"))


@query("f22_wells", "SELECT read_id, read_id >> 16 AS well_row, read_id & 65535 AS well_column FROM (SELECT DISTINCT read_id * 977 AS read_id FROM raw_read)")
def f22(spark, d):
    w = table(spark, d, "raw_read").select((F.col("read_id") * 977).alias("read_id")).distinct()
    return w.select("read_id", N.well_row(F.col("read_id")).alias("well_row"), N.well_column(F.col("read_id")).alias("well_column"))


@query("f9_trimmed_subreads", "SELECT read_id, 'm1/' || read_id || '/' || (read_id % 9 + 3) || '_' || (read_id + 90) AS name FROM (SELECT DISTINCT read_id FROM raw_read)")
def f9(spark, d):
    i = F.col("read_id")
    n = F.concat(F.lit("m1/"), i, F.lit("/"), i % 9, F.lit("_"), i + 100)
    return table(spark, d, "raw_read").select("read_id").distinct().select("read_id", N.trimmed_subread(n, F.lit(3), F.lit(10)).alias("name"))
