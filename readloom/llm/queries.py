"""The pN_ queries of the problems solved in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.reads import bare_name, one_per_read
from readloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from readloom.llm.near_duplicates import expand_pairs, similar_pairs

    return expand_pairs(*similar_pairs(table(spark, d, "raw_read").select("read_id", "seq"), k=12, threshold=0.6))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from readloom.llm.groups import connected_groups

    good = (F.col("match_length").isNotNull()) & (100 * F.col("identity").cast("bigint") >= 98 * F.col("match_length").cast("bigint"))
    names = table(spark, d, "raw_read").select(bare_name(F.col("name")).alias("name"), "read_id").where("name is not null and read_id is not null").distinct()
    matches = table(spark, d, "pair_match").where(good & (F.col("gap") <= 2)).select(bare_name(F.col("read1")).alias("n1"), bare_name(F.col("read2")).alias("n2")).where("n1 <> n2").distinct()
    # rows sent again differ in header parts at most, so distinct names are all that counts
    by_name = matches.join(names.select(F.col("name").alias("n1"), F.col("read_id").alias("a")), "n1").join(names.select(F.col("name").alias("n2"), F.col("read_id").alias("b")), "n2").select("a", "b")
    listed = table(spark, d, "read_score").where(good).select(F.col("read_id").alias("a"), F.explode("read_list").alias("b"))
    return connected_groups(by_name.unionByName(listed)).select(F.col("id").alias("read_id"), "group_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from readloom.llm.shared_spans import shared_spans

    reads = table(spark, d, "raw_read").withColumn("name", bare_name(F.col("name")))
    return shared_spans(reads, 64).select("read_name", F.col("span_start").cast("bigint"), F.col("span_stop").cast("bigint"))


def p4_shared(spark: SparkSession, d: str) -> DataFrame:
    from readloom.llm.shared_spans import shared_amounts

    reads = table(spark, d, "raw_read").withColumn("name", bare_name(F.col("name")))
    return shared_amounts(reads, 64).drop("read_id")


def _limit(spark: SparkSession, d: str) -> int:
    rows = table(spark, d, "raw_read").count()
    return max(6, -(-rows // 400))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from readloom.llm.heavy_hitters import frequent_values

    return frequent_values(table(spark, d, "raw_read").select(F.upper("seq").alias("seq")), "seq", _limit(spark, d)).select(F.col("value").alias("seq"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same values with their exact counts, and whether the sketch's estimate is at least that."""
    from readloom.llm.heavy_hitters import frequent_values

    found = frequent_values(table(spark, d, "raw_read").select(F.upper("seq").alias("seq")), "seq", _limit(spark, d))
    return found.select(F.col("value").alias("seq"), "n_rows", (F.col("n_estimated") >= F.col("n_rows")).alias("covered"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from readloom.llm.top_n import top_n

    scores = table(spark, d, "read_score").where("match_length is not null and identity is not null and read_length is not null")
    first = F.get(F.col("read_list"), F.lit(0))
    order = [-F.col("match_length"), -F.col("identity"), -F.col("read_length"), first.isNull(), F.coalesce(first, F.lit(0))]
    return top_n(scores, "read_id", "score_id", order, 3).select("read_id", "rank_no", "score_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from readloom.llm.term_counts import base_word_counts

    reads = table(spark, d, "raw_read")
    n = reads.select(F.count_distinct("read_id")).first()[0]
    return base_word_counts(one_per_read(reads, keep=("seq",)), 32, 4, max(12, -(-n // 400)), only="kept").select(F.col("term").alias("kmer"))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many words have each mark, over the whole collection."""
    from readloom.llm.term_counts import base_word_counts

    reads = table(spark, d, "raw_read")
    n = reads.select(F.count_distinct("read_id")).first()[0]
    counts = base_word_counts(one_per_read(reads, keep=("seq",)), 32, 4, max(12, -(-n // 400)))
    return counts.groupBy("mark").agg(F.count("*").alias("n_terms"), F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def p7_prose_terms(spark: SparkSession, d: str) -> DataFrame:
    """Blank-separated words of the documents' texts with their occurrences and documents, without those in fewer than 5 documents or in a fifth of them."""
    from readloom.llm.term_counts import term_counts

    docs = table(spark, d, "documents").select("doc_id", "text")
    n = docs.count()
    words = F.filter(F.split(F.lower("text"), "[ \\n\\r\\t]+"), lambda x: x != "")
    return term_counts(docs, "doc_id", words, 5, -(-n // 5)).where("mark = 'kept'").select("term", "occurrences", "records")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    from readloom.llm.tokens import with_sizes
    from readloom.session import written

    return written(with_sizes(table(spark, d, "documents"), ["doc_id", "source"]), "sizes")[0]


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    from readloom.llm.packing import pack_items

    return pack_items(_sized(spark, d), table(spark, d, "pack_bin"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    from readloom.llm.packing import fill_report

    return fill_report(p8_packed(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    from readloom.llm.mixing import mix_sources

    return mix_sources(_sized(spark, d), table(spark, d, "mix_target"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    from readloom.llm.mixing import mix_sources

    return mix_sources(_sized(spark, d), table(spark, d, "mix_target"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from readloom.llm.reading_level import reading_levels

    return reading_levels(table(spark, d, "documents"), table(spark, d, "level_label")).select("doc_id", "reading_level")


_ONE = "one AS (SELECT read_id, arg_min(struct_pack(name := name, seq := upper(seq)), (loaded_at, file, read_idx)) AS r FROM raw_read WHERE read_id IS NOT NULL GROUP BY read_id), rd AS (SELECT read_id, nullif(regexp_extract(r.name, '^\\s*[>@]?([^\\s]*)', 1), '') AS name, r.seq AS seq FROM one)"


def _words(k: int, key: str, src: str) -> str:
    """Every window of k plain bases of (key, seq) rows."""
    return f"(SELECT {key}, p - 1 AS pos, substr(seq, p, {k}) AS w FROM (SELECT {key}, seq, unnest(range(1, length(seq) - {k} + 2)) AS p FROM {src})) WHERE regexp_full_match(w, '[ACGT]{{{k}}}')"


_CANONICAL = "least(w, reverse(translate(w, 'ACGT', 'TGCA')))"
_SHARED = f"""WITH {_ONE}, wn AS MATERIALIZED (SELECT read_id, pos, w FROM {_words(64, "read_id", "rd")}), sh AS (SELECT w FROM wn GROUP BY w HAVING count(DISTINCT read_id) > 1),
ps AS (SELECT DISTINCT read_id, pos + i AS pos FROM wn JOIN sh USING (w), range(64) AS t(i)),
sp AS (SELECT read_id, min(pos) AS a, max(pos) + 1 AS e FROM (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS g FROM ps) GROUP BY read_id, g)"""
_FREQUENT = "WITH n AS (SELECT greatest(6, ceil(count(*) / 400)) AS least FROM raw_read), g AS (SELECT upper(seq) AS seq, count(*) AS n_rows FROM raw_read WHERE seq <> '' GROUP BY 1)"
_TERMS = f"""WITH {_ONE}, t AS (SELECT {_CANONICAL} AS kmer, count(*) AS n, count(DISTINCT read_id) AS r FROM {_words(32, "read_id", "rd")} GROUP BY 1), n AS (SELECT greatest(12, ceil(count(DISTINCT read_id) / 400)) AS below FROM raw_read)"""
ORACLE: dict[str, str] = {
    "p1_found": f"""WITH s AS (SELECT upper(seq) AS seq, min(read_id) AS id FROM raw_read WHERE seq <> '' GROUP BY 1), w AS MATERIALIZED (SELECT DISTINCT id, {_CANONICAL} AS w FROM {_words(12, "id", "s")}),
n AS (SELECT id, count(*) AS n FROM w GROUP BY id), b AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM w x JOIN w y ON x.w = y.w AND x.id < y.id GROUP BY 1, 2)
SELECT a AS read_id1, b AS read_id2 FROM b JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 10 * c >= 6 * (p.n + q.n - c)""",
    "p2_found": """WITH RECURSIVE nm AS (SELECT DISTINCT nullif(regexp_extract(name, '^\\s*[>@]?([^\\s]*)', 1), '') AS name, read_id FROM raw_read WHERE read_id IS NOT NULL),
m AS (SELECT DISTINCT regexp_extract(read1, '^\\s*[>@]?([^\\s]*)', 1) AS n1, regexp_extract(read2, '^\\s*[>@]?([^\\s]*)', 1) AS n2 FROM pair_match WHERE 100 * identity::BIGINT >= 98 * match_length::BIGINT AND gap <= 2),
l AS (SELECT x.read_id AS a, y.read_id AS b FROM m JOIN nm x ON x.name = n1 JOIN nm y ON y.name = n2 UNION SELECT read_id, unnest(read_list) FROM read_score WHERE 100 * identity::BIGINT >= 98 * match_length::BIGINT),
e AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) WHERE a <> b),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS read_id, min(b) AS group_id FROM r GROUP BY a""",
    "p4_found": f"{_SHARED} SELECT name AS read_name, a::BIGINT AS span_start, e::BIGINT AS span_stop FROM sp JOIN rd USING (read_id)",
    "p4_shared": f"{_SHARED}, t AS (SELECT read_id, sum(e - a)::BIGINT AS n FROM sp GROUP BY read_id) SELECT name AS read_name, length(seq) AS read_length, coalesce(n, 0) AS shared_bases, round(coalesce(n, 0) / length(seq), 6) AS shared_part FROM rd LEFT JOIN t USING (read_id) WHERE seq <> ''",
    "p5_found": f"{_FREQUENT} SELECT seq FROM g, n WHERE n_rows >= least",
    "p5_counts": f"{_FREQUENT} SELECT seq, n_rows, TRUE AS covered FROM g, n WHERE n_rows >= least",
    "p6_found": """WITH s AS (SELECT DISTINCT ON (score_id) * FROM read_score WHERE read_id IS NOT NULL AND match_length IS NOT NULL AND identity IS NOT NULL AND read_length IS NOT NULL)
SELECT read_id, row_number() OVER (PARTITION BY read_id ORDER BY match_length DESC, identity DESC, read_length DESC, read_list[1] NULLS LAST, score_id) AS rank_no, score_id FROM s QUALIFY rank_no <= 3""",
    "p7_found": f"{_TERMS} SELECT kmer FROM t, n WHERE r >= 4 AND r < below",
    "p7_counts": f"{_TERMS} SELECT CASE WHEN r < 4 THEN 'rare' WHEN r >= below THEN 'common' ELSE 'kept' END AS mark, count(*) AS n_terms, sum(n)::BIGINT AS occurrences, sum(r)::BIGINT AS records FROM t, n GROUP BY 1",
    "p7_prose_terms": """WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\n\\r\\t]+'), lambda x: x <> '')) AS term FROM documents WHERE doc_id IS NOT NULL), n AS (SELECT ceil(count(*) / 5) AS below FROM documents)
SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM w GROUP BY term HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) < (SELECT below FROM n)""",
}
QUERIES = {
    q.__name__: q for q in (p1_found, p2_found, p4_found, p4_shared, p5_found, p5_counts, p6_found, p7_found, p7_counts, p7_prose_terms, p8_packed, p8_fill, p9_mix, p9_shares, p10_found)
}
