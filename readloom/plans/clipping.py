"""Per-read functions: pairing with qualities, clipping, filters, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.functions import dna
from readloom.functions.reads import bare_name
from readloom.operators import kmers as K
from readloom.operators import reads as R
from readloom.plans.masking import one
from readloom.plans.sqlkit import READS, reads
from readloom.session import table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


FULL = f"""WITH {READS}, full_ AS (SELECT file, read_idx, name, comment, seq, CASE WHEN qual IS NULL OR len(qual) < length(seq) THEN list_transform(range(length(seq)), lambda x: 20) ELSE qual[1:length(seq)] END AS qual FROM reads),
o AS (SELECT name, arg_min(seq, file) AS seq, arg_min(struct_pack(q := qual), file).q AS qual FROM full_ GROUP BY name)"""
STRS = "array_to_string(qual, ',') AS quals"


def quals(c="qual"):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias("quals")


@query("s1_first_of_name", "SELECT file, name, min(read_idx) AS read_idx FROM raw_read GROUP BY file, name")
def s1(spark, d):
    return R.first_of_name(table(spark, d, "raw_read")).select("file", "name", "read_idx")


@query("s4_pair_quality", f"{FULL} SELECT name, {STRS} FROM o")
def s4(spark, d):
    r = reads(spark, d).groupBy("name").agg(F.min_by(F.struct("seq", "qual"), "file").alias("r")).select("name", "r.seq", "r.qual")
    return R.pair_quality(r.select("name", "seq"), r.select("name", "qual"), 20).select("name", quals())


@query("f1_base_codes", f"WITH {READS} SELECT strpos('ACGT', upper(substr(seq, 5, 1))) - 1 AS code, count(*) AS n FROM reads WHERE length(seq) >= 5 GROUP BY ALL")
def f1(spark, d):
    return reads(spark, d).where(F.length("seq") >= 5).groupBy(dna.base_code(F.substring("seq", 5, 1)).alias("code")).agg(F.count("*").alias("n"))


@query("f1_base_codes_all", f"WITH {READS} SELECT strpos('ACGT', b) - 1 AS code, count(*) AS n FROM (SELECT unnest(string_split(upper(seq), '')) AS b FROM reads WHERE seq <> '') GROUP BY ALL")
def f1_all(spark, d):
    bases = reads(spark, d).where("seq <> ''").select(F.explode(F.split("seq", "")).alias("b")).where("b <> ''")
    return bases.groupBy(dna.base_code(F.col("b")).alias("code")).agg(F.count("*").alias("n"))


@query("f2_reverse_complement", f"WITH {READS} SELECT file, read_idx, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS rc, CASE WHEN regexp_full_match(upper(seq), '[ACGT]*') THEN reverse(translate(upper(seq), 'ACGT', 'TGCA')) END AS strict_rc FROM reads")
def f2(spark, d):
    return reads(spark, d).select("file", "read_idx", dna.reverse_complement(F.col("seq")).alias("rc"), dna.strict_reverse_complement(F.col("seq")).alias("strict_rc"))


@query("f3_canonical_prefix", f"WITH {READS} SELECT file, read_idx, least(upper(substr(seq, 1, 20)), reverse(translate(upper(substr(seq, 1, 20)), 'ACGT', 'TGCA'))) AS kmer FROM reads")
def f3(spark, d):
    return reads(spark, d).select("file", "read_idx", dna.canonical(F.upper(F.substring("seq", 1, 20))).alias("kmer"))


@query("f3_canonical_all", f"WITH {READS} SELECT file, read_idx, least(upper(seq), reverse(translate(upper(seq), 'ACGT', 'TGCA'))) AS kmer FROM reads")
def f3_all(spark, d):
    return reads(spark, d).select("file", "read_idx", dna.canonical(F.upper("seq")).alias("kmer"))


@query("f5_gc_count", f"WITH {READS} SELECT file, read_idx, length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')) AS gc FROM reads")
def f5(spark, d):
    return reads(spark, d).select("file", "read_idx", dna.gc_count(F.col("seq")).alias("gc"))


@query("f14_quality_codes", f"{FULL}, t AS (SELECT name, list_transform(qual, lambda q: least(255, greatest(0, ascii(chr((q + 33)::INT)) - 33))) AS qual FROM o) SELECT name, {STRS} FROM t")
def f14(spark, d):
    text = F.array_join(F.transform("qual", lambda q: F.char(q + 33)), "")
    return one(spark, d).withColumn("t", text).select("name", F.when(F.col("t") == "", "").otherwise(F.array_join(dna.decode_quality(F.col("t")).cast("array<string>"), ",")).alias("quals"))


@query("f15_quality_offset", f"{FULL}, m AS (SELECT min(x) + 33 AS lo, max(x) + 33 AS hi FROM (SELECT unnest(qual) AS x FROM o)) SELECT CASE WHEN lo > 63 AND hi < 77 THEN NULL WHEN lo > 32 AND hi < 77 THEN 33 WHEN lo > 63 AND hi < 115 THEN 64 END AS quality_offset FROM m")
def f15(spark, d):
    from readloom.functions.names import quality_offset

    codes = one(spark, d).select(F.array_join(F.transform("qual", lambda q: F.char(q + 33)), "").alias("text"))
    return quality_offset(codes, "text")


@query("f16_strip_zero_quality", f"{FULL}, z AS (SELECT name, list_transform(qual, lambda q: CASE WHEN q <= 23 THEN 0 ELSE q END) AS q FROM o), i AS (SELECT name, q, list_min(list_filter(list_transform(q, lambda x, i: CASE WHEN x > 0 THEN i END), lambda x: x IS NOT NULL)) AS a, list_max(list_filter(list_transform(q, lambda x, i: CASE WHEN x > 0 THEN i END), lambda x: x IS NOT NULL)) AS b FROM z) SELECT name, coalesce(array_to_string(q[a:b], ','), '') AS quals FROM i")
def f16(spark, d):
    zero = F.transform("qual", lambda q: F.when(q <= 23, 0).otherwise(q))
    return one(spark, d).withColumn("qual", zero).select("name", F.array_join(R.strip_zero_quality(F.col("qual")).cast("array<string>"), ",").alias("quals"))


@query("f24_reversed_quality", f"{FULL} SELECT name, array_to_string(list_reverse(qual), ',') AS quals FROM o")
def f24(spark, d):
    return one(spark, d).withColumn("qual", F.reverse("qual")).select("name", quals())


SPAN = f"""{FULL}, b AS (SELECT name, qual, p - 1 AS pos FROM (SELECT name, seq, qual, unnest(range(1, length(seq) + 1)) AS p FROM o) WHERE upper(substr(seq, p, 1)) NOT IN ('N', 'X')),
g AS (SELECT name, pos, qual[pos + 1] AS q, pos - row_number() OVER (PARTITION BY name ORDER BY pos) AS g FROM b),
r AS (SELECT name, min(pos) AS start, max(pos) + 1 AS stop, count(*) FILTER (q >= 20) AS score FROM g GROUP BY name, g),
v AS (SELECT name, start, stop FROM r QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, start) = 1)"""


def with_span(spark, d):
    r = one(spark, d).withColumn("v", R.vector_span(F.col("seq"), F.col("qual"), 20, and_n=True))
    return r.select("name", "seq", "qual", F.coalesce("v.start", F.lit(0)).alias("v_start"), F.coalesce("v.stop", F.lit(0)).alias("v_stop"))


@query("vector_span", f"{SPAN} SELECT o.name, coalesce(start, 0)::INT AS v_start, coalesce(stop, 0)::INT AS v_stop FROM o LEFT JOIN v USING (name)")
def vspan(spark, d):
    return with_span(spark, d).select("name", "v_start", "v_stop")


ORACLE_CLIP = f"""{SPAN}, x AS (SELECT name, start AS v0, unnest(range(start, stop)) AS pos FROM v),
qs AS (SELECT x.name, v0, pos, sum(qual[pos + 1]) OVER (PARTITION BY x.name ORDER BY pos ROWS 19 PRECEDING) AS s FROM x JOIN o USING (name)),
cl AS (SELECT name, greatest(min(pos) - 19, any_value(v0), 0)::INT AS q_start, (max(pos) + 1)::INT AS q_stop FROM qs WHERE s >= 500 GROUP BY name),
qc AS (SELECT o.name, seq, qual, coalesce(q_start, 0) AS q_start, coalesce(q_stop, 0) AS q_stop FROM o LEFT JOIN cl USING (name))"""


@query("quality_clip", f"{ORACLE_CLIP} SELECT name, q_start, q_stop FROM qc")
def qclip(spark, d):
    return R.quality_clip(with_span(spark, d), 25)


@query("clipped_high_quality_count", f"{ORACLE_CLIP} SELECT name, len(list_filter(qual[q_start + 1:q_stop], lambda q: q >= 20)) AS n FROM qc")
def qcount(spark, d):
    c = one(spark, d).join(R.quality_clip(with_span(spark, d), 25), "name")
    return c.select("name", R.high_quality_count(F.expr("slice(qual, q_start + 1, q_stop - q_start)")).cast("bigint").alias("n"))


@query("soft_clip", f"""{FULL}, x AS (SELECT name, qual, unnest(range(len(qual))) AS pos FROM o WHERE len(qual) >= 20), s AS (SELECT name, pos, sum(qual[pos + 1]) OVER (PARTITION BY name ORDER BY pos ROWS 19 PRECEDING) AS s FROM x),
c AS (SELECT name, (min(pos) - 19)::INT AS hq_start, (max(pos) + 1)::INT AS hq_stop FROM s WHERE pos >= 19 AND s >= 500 GROUP BY name) SELECT o.name, coalesce(hq_start, 0) AS hq_start, coalesce(hq_stop, 0) AS hq_stop FROM o LEFT JOIN c USING (name)""")
def softc(spark, d):
    return R.soft_clip(one(spark, d))


@query("linker_clip", f"{FULL}, c AS (SELECT name, CASE WHEN regexp_matches(seq, '(?i)GAT[TC]ACA|CATGA') THEN strpos(lower(seq), lower(regexp_extract(seq, '(?i)GAT[TC]ACA|CATGA'))) - 1 ELSE length(seq) END AS n, seq, qual FROM o) SELECT name, substr(seq, 1, n) AS seq, array_to_string(qual[1:n], ',') AS quals FROM c")
def linker(spark, d):
    return R.linker_clip(one(spark, d), "GAT[TC]ACA|CATGA").select("name", "seq", quals())


@query("mask_low_quality", f"{FULL} SELECT name, CASE WHEN seq = '' THEN '' ELSE array_to_string(list_transform(range(length(seq)), lambda i: CASE WHEN qual[i + 1] < 24 THEN 'X' ELSE substr(seq, i + 1, 1) END), '') END AS seq FROM o")
def masklow(spark, d):
    return one(spark, d).select("name", F.when(F.col("seq") == "", "").otherwise(dna.mask_low_quality(F.col("seq"), F.col("qual"), 24)).alias("seq"))


NAMES = "nm AS (SELECT DISTINCT regexp_extract(read_name, '^\\s*[>@]?([^\\s]*)', 1) AS name FROM thread_output)"


def names(spark, d):
    return table(spark, d, "thread_output").select(bare_name(F.col("read_name")).alias("name")).distinct()


@query("read_filters", f"{FULL}, {NAMES} SELECT name FROM o WHERE length(seq) >= 150 AND regexp_matches(name, '^(m9|X[KL])') AND name NOT IN (SELECT name FROM nm)")
def filters(spark, d):
    return R.select_reads(one(spark, d), 150, "^(m9|X[KL])", names(spark, d)).select("name")


@query("length_filter", f"{FULL} SELECT name, length(seq) AS n FROM o WHERE length(seq) BETWEEN 100 AND 200")
def lengths(spark, d):
    return R.select_reads(one(spark, d), 100, most=200).select("name", F.length("seq").alias("n"))


@query("sub_reads", f"{FULL} SELECT concat(name, '_11 ', greatest(least(60, length(seq)) - 10, 0)) AS name, substr(seq, 11, greatest(least(60, length(seq)) - 10, 0)) AS seq, array_to_string(qual[11:least(60, length(seq))], ',') AS quals FROM o")
def subreads(spark, d):
    return R.sub_read(one(spark, d), F.lit(10), F.lit(60)).select("name", "seq", quals())


@query("plain_ranges", f"""{FULL}, b AS (SELECT name, p - 1 AS pos FROM (SELECT name, seq, unnest(range(1, length(seq) + 1)) AS p FROM o) WHERE substr(seq, p, 1) SIMILAR TO '[ACGTacgt]')
SELECT name, min(pos)::INT AS start, (max(pos) + 1)::INT AS stop FROM (SELECT name, pos, pos - row_number() OVER (PARTITION BY name ORDER BY pos) AS g FROM b) GROUP BY name, g HAVING count(*) >= 24""")
def plain(spark, d):
    return K.plain_ranges(one(spark, d), 24, ["name"])


@query("complemented_reads", f"{FULL} SELECT name, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS seq, array_to_string(list_reverse(qual), ',') AS quals FROM o")
def complemented(spark, d):
    return R.complemented(one(spark, d)).select("name", "seq", quals())


@query("j9_validate_quality", f"WITH {READS}, s AS (SELECT name, length(arg_min(seq, file)) AS n FROM reads GROUP BY name), q AS (SELECT name, len(arg_min(struct_pack(q := qual), file).q) AS m FROM reads GROUP BY name), j AS (SELECT name, CASE WHEN m IS NULL THEN 'no quality' WHEN n IS NULL THEN 'no sequence' WHEN n <> m THEN 'length' END AS problem FROM s LEFT JOIN (SELECT * FROM q WHERE m IS NOT NULL) USING (name)) SELECT * FROM j WHERE problem IS NOT NULL")
def j9(spark, d):
    r = reads(spark, d).groupBy("name").agg(F.min_by(F.struct("seq", "qual"), "file").alias("r")).select("name", "r.seq", "r.qual")
    return R.validate_quality(r.select("name", "seq"), r.select("name", "qual"))


@query("j10_include_exclude", f"{FULL}, {NAMES} SELECT name, 1 AS side FROM o WHERE name IN (SELECT name FROM nm) UNION ALL SELECT name, 2 FROM o WHERE name NOT IN (SELECT name FROM nm)")
def j10(spark, d):
    r, n = one(spark, d), names(spark, d)
    return R.by_names(r, include=n).select("name", F.lit(1).alias("side")).unionByName(R.by_names(r, exclude=n).select("name", F.lit(2).alias("side")))


@query("j10_last_option_decides", f"{FULL}, op AS (SELECT out_id AS ord, regexp_extract(read_name, '^\\s*[>@]?([^\\s]*)', 1) AS name, buffer_id % 2 = 0 AS keep FROM thread_output), l AS (SELECT name, arg_max(keep, ord) AS keep FROM op GROUP BY name) SELECT name FROM o WHERE name IN (SELECT name FROM l WHERE keep)")
def j10_options(spark, d):
    o = table(spark, d, "thread_output").select(F.col("out_id").alias("ord"), bare_name(F.col("read_name")).alias("name"), (F.col("buffer_id") % 2 == 0).alias("keep"))
    return R.name_options(one(spark, d), o).select("name")


RANGES = "rg AS (SELECT buffer_id % 3 AS list_id, out_id AS ord, regexp_extract(read_name, '^\\s*[>@]?([^\\s]*)', 1) AS name, (out_id % 40)::BIGINT AS start, CASE WHEN out_id % 5 = 0 THEN 0 ELSE (out_id % 40 + 90)::BIGINT END AS stop FROM thread_output)"


def ranges(spark, d):
    o = F.col("out_id")
    return table(spark, d, "thread_output").select((F.col("buffer_id") % 3).alias("list_id"), o.alias("ord"), bare_name(F.col("read_name")).alias("name"), (o % 40).alias("start"), F.when(o % 5 == 0, 0).otherwise(o % 40 + 90).cast("bigint").alias("stop"))


@query("r2_extract_ranges", f"{FULL}, {RANGES}, u AS (SELECT list_id, name, start, stop, min(ord) AS ord FROM rg GROUP BY ALL), e AS (SELECT *, CASE WHEN stop = 0 THEN length(seq) ELSE least(stop, length(seq)) END AS e FROM o JOIN u USING (name)) SELECT list_id, ord, name, start, e::BIGINT AS stop, substr(seq, start + 1, greatest(0, e - start)) AS seq, stop > length(seq) OR start >= length(seq) AS beyond FROM e")
def r2(spark, d):
    return R.extract_ranges(one(spark, d), ranges(spark, d))


@query("u5_distinct_ranges", f"WITH {RANGES} SELECT list_id, name, start, stop, min(ord) AS ord FROM rg GROUP BY ALL")
def u5(spark, d):
    return ranges(spark, d).groupBy("list_id", "name", "start", "stop").agg(F.min("ord").alias("ord"))


@query("s16_fasta_records", f"{FULL} SELECT name, '>' || name || chr(10) || regexp_replace(regexp_replace(seq, '(.{{50}})', '\\1' || chr(10), 'g'), chr(10) || '$', '') AS record FROM o")
def s16(spark, d):
    return one(spark, d).select("name", R.fasta_record(F.col("name"), F.col("seq")).alias("record"))


@query("s17_fastq_records", f"{FULL} SELECT name, '@' || name || chr(10) || seq || chr(10) || '+' || chr(10) || array_to_string(list_transform(qual, lambda q: chr((q + 33)::INT)), '') AS record FROM o")
def s17(spark, d):
    return one(spark, d).select("name", R.fastq_record(F.col("name"), F.col("seq"), F.col("qual")).alias("record"))


@query("o5_limit_by_order", f"WITH {READS} SELECT file, read_idx, name FROM reads ORDER BY file, read_idx, name LIMIT 100")
def o5(spark, d):
    return reads(spark, d).select("file", "read_idx", "name").orderBy("file", "read_idx", "name").limit(100)
