"""File formats: the reads written, read back, and compared with the table; all files lie in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from readloom.operators.reads import fastq_record
from readloom.plans.masking import ONE, one
from readloom.session import shared_folder
from readloom.sources import files, text

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"


NAMED = f"{ONE} SELECT name, seq FROM one"


@query("s1_fasta_round_trip", NAMED)
def s1(spark, d):
    path = folder(spark, "fasta")
    text.write_fasta(one(spark, d), path)
    files.register(spark)
    return spark.read.format("readloom_fasta").option("splitBytes", 1 << 20).load(path).select("name", "seq")


@query("s2_fastq_round_trip", f"{ONE} SELECT name, seq, array_to_string(list_transform(qual, lambda q: least(q, 93)), ' ') AS quals FROM one")
def s2(spark, d):
    path = folder(spark, "fastq")
    text.write_fastq(one(spark, d), path)
    files.register(spark)
    return spark.read.format("readloom_fastq").option("splitBytes", 1 << 20).load(path).select("name", "seq", F.array_join("qual", " ").alias("quals"))


@query("s6_compressed_fastq", f"{ONE} SELECT name, seq FROM one")
def s6(spark, d):
    """FASTQ records in order of name as xz files, read back."""
    path = folder(spark, "fastq-xz")
    text.write_lines(one(spark, d).select("name", fastq_record(F.col("name"), F.col("seq"), F.col("qual")).alias("value")), path, order=["name"], codec="xz")
    files.register(spark)
    return spark.read.format("readloom_fastq").load(path).select("name", "seq")


@query("s7_ordered_lines", "SELECT row_number() OVER (ORDER BY line_id) - 1 AS n, coalesce(raw_line, '') AS value FROM match_line WHERE raw_line IS NULL OR NOT contains(raw_line, chr(10))")
def s7(spark, d):
    """The lines of match_line in order, written as zst files and numbered as they are read."""
    from readloom.operators.order import Ordered
    from readloom.session import table

    path = folder(spark, "lines")
    lines = table(spark, d, "match_line").where("raw_line is null or not contains(raw_line, chr(10))")
    text.write_lines(lines, path, value="raw_line", order=["line_id"], codec="zst")
    return Ordered(spark.read.format("readloom_lines").load(path), "file", "line_no").numbered("n")[0].select("n", "value")


# matches made of pair_match: numbers of its columns, sequences by length of match
MATCHES = """m AS (SELECT match_id, regexp_extract(read1, '^\\s*[>@]?([^\\s]*)', 1) AS query_id, regexp_extract(read2, '^\\s*[>@]?([^\\s]*)', 1) AS id, read_length::BIGINT AS length, identity::BIGINT AS identity, match_length::BIGINT AS score FROM pair_match),
k AS (SELECT DISTINCT * FROM m WHERE query_id <> '' AND id <> '' AND identity IS NOT NULL AND length IS NOT NULL AND score IS NOT NULL)"""
SEQS = "1::BIGINT AS start, 12::BIGINT AS stop, 3::BIGINT AS s_start, (score % 7 + 12)::BIGINT AS s_stop, 'ACGTACGTAC' || chr((65 + 2 * (score % 2))::INT) || 'G' AS qs, 'ACGTACGTACGG' AS ss"


def matches(spark, d):
    from readloom.functions.reads import bare_name
    from readloom.session import table

    m = table(spark, d, "pair_match").select(bare_name(F.col("read1")).alias("query_id"), bare_name(F.col("read2")).alias("id"), *[F.col(a).cast("bigint").alias(b) for a, b in (("read_length", "length"), ("identity", "identity"), ("match_length", "score"))], "match_id")
    k = m.dropna().distinct()
    return k.select("query_id", "id", "length", "identity", "score", F.lit(1).alias("start"), F.lit(12).alias("stop"), F.lit(3).alias("s_start"), (F.col("score") % 7 + 12).alias("s_stop"), F.concat(F.lit("ACGTACGTAC"), F.when(F.col("score") % 2 == 0, "A").otherwise("C"), F.lit("G")).alias("qs"), F.lit("ACGTACGTACGG").alias("ss"))


@query("s10_blast_text", f"WITH {MATCHES} SELECT query_id, id, length, identity, score, {SEQS} FROM k")
def s10(spark, d):
    path = folder(spark, "blast")
    t = "Query= {query_id}\n\n>{id} x\n          Length = {length}\n\n Score = {score} bits (1)\n Identities = {identity}/{score} (9%)\n Strand = Plus / Plus\n\nQuery: {start} {qs} {stop}\n          |||\nSbjct: {s_start} {ss} {s_stop}\n\n"
    text.write_lines(matches(spark, d).select(filled(t)), path)
    return spark.read.format("readloom_blast").load(path)


@query("s11_compact_matches", f"WITH {MATCHES} SELECT query_id, id, length, identity, score, {SEQS} FROM k")
def s11(spark, d):
    path = folder(spark, "compact")
    text.write_lines(matches(spark, d).select(filled("={query_id}\n>{id} {length}\n{identity} {score} {start} {stop} {s_start} {s_stop}\n{qs} {ss}")), path, codec="gz")
    return spark.read.format("readloom_match").load(path)


def filled(template: str):
    """A text with {column} in it, as one column."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts) if x]).alias("value")


@query("s12_bam_round_trip", f"{ONE} SELECT name, upper(regexp_replace(seq, '[^ACGTRYSWKMBDHVNacgtryswkmbdhvn=]', 'N', 'g')) AS seq, array_to_string(list_transform(qual, lambda q: least(q, 93)), ' ') AS quals FROM one")
def s12(spark, d):
    path = folder(spark, "bam")
    files.register(spark)
    none = F.lit(None).cast("bigint")
    rows = one(spark, d).select(F.col("name").alias("full_name"), F.lit(4).alias("flag"), F.lit(None).cast("string").alias("ref_name"), F.lit(-1).cast("bigint").alias("pos"), "seq", "qual", none.alias("hole_number"), none.alias("q_start"), none.alias("q_end"), none.alias("num_passes"))
    rows.write.format("readloom_bam").mode("overwrite").save(path)
    back = spark.read.format("readloom_bam").option("splitBytes", 1 << 18).load(path)
    return back.select(F.col("full_name").alias("name"), "seq", F.array_join(F.coalesce("qual", F.array().cast("array<int>")), " ").alias("quals"))


@query("s13_saved_counts", f"{ONE} SELECT kmer, cnt FROM kc")
def s13(spark, d):
    from readloom.operators import kmers as K

    path = folder(spark, "counts")
    text.save_counts(K.counts(one(spark, d), 12), path, 8)
    return spark.read.parquet(path).select("kmer", "cnt")


@query("s18_trace_descriptions")
def s18(spark, d):
    return text.trace_descriptions(one(spark, d), {"CENTER_NAME": "X"})


@query("s19_name_list", "SELECT DISTINCT regexp_extract(read_name, '^\\s*[>@]?([^\\s]*)', 1) AS name FROM thread_output WHERE regexp_extract(read_name, '^\\s*[>@]?([^\\s]*)', 1) <> ''")
def s19(spark, d):
    from readloom.session import table

    path = folder(spark, "names")
    text.write_lines(table(spark, d, "thread_output"), path, value="read_name")
    return text.read_names(spark, path).distinct()


@query("x1_sql_functions", f"{ONE} SELECT name, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS rc FROM one")
def x1(spark, d):
    from readloom.functions import sql

    sql.register_functions(spark)
    one(spark, d).createOrReplaceTempView("__reads_for_sql")
    return spark.sql("SELECT name, reverse_complement(seq) AS rc FROM __reads_for_sql")
