"""Text scans and sinks that need no custom reader: PSL, name lists, small tables, FASTA, FASTQ, quality and trace-description text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.names import parsed_name
from readloom.functions.reads import bare_name
from readloom.operators.align import parse_psl
from readloom.operators.reads import fasta_record, fastq_record, quality_record


def read_psl(spark: SparkSession, path: str) -> DataFrame:
    return parse_psl(spark.read.text(path))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a list with one name a line; header parts are dropped."""
    return spark.read.text(path).select(bare_name(F.col("value")).alias("name")).where("name is not null")


def read_columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Blank-separated columns (barcode, loci, linker and library tables); lines with too few columns are left out."""
    f = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    return spark.read.text(path).select(f.alias("f")).where(F.size("f") >= len(names)).select(*[F.col("f")[i].alias(n) for i, n in enumerate(names)])


def write_fasta(reads: DataFrame, path: str, width: int = 50, compression: str = "none") -> None:
    reads.select(fasta_record(F.col("name"), F.col("seq"), width).alias("value")).write.option("compression", compression).mode("overwrite").text(path)


def write_quality(reads: DataFrame, path: str, most: int | None = None, compression: str = "none") -> None:
    reads.select(quality_record(F.col("name"), F.col("qual"), most=most).alias("value")).write.option("compression", compression).mode("overwrite").text(path)


def write_fastq(reads: DataFrame, path: str, by: list[str] | None = None, compression: str = "none") -> None:
    """FASTQ text, in folders by the given columns (a mate number, a barcode route, a list)."""
    out = reads.select(*(by or []), fastq_record(F.col("name"), F.col("seq"), F.col("qual")).alias("value"))
    w = out.write.option("compression", compression).mode("overwrite")
    (w.partitionBy(*by) if by else w).text(path)


def trace_descriptions(reads: DataFrame, constants: dict[str, str] | None = None) -> DataFrame:
    """(name, value): one XML trace element a read, from the parsed name and constant elements."""
    p = parsed_name(F.col("name"))
    fields = [("TEMPLATE_ID", p["template"]), ("TRACE_DIRECTION", p["direction"]), ("TRACE_END", p["direction"]), ("TRACE_NAME", F.col("name")), ("WELL_ID", p["well"])]
    body = [F.lit(f"<{k}>{v}</{k}>\n") for k, v in (constants or {}).items()] + [F.concat(F.lit(f"<{k}>"), v, F.lit(f"</{k}>\n")) for k, v in fields]
    return reads.select("name", F.concat(F.lit("<trace>\n"), *body, F.lit("</trace>\n")).alias("value"))


def write_split(df: DataFrame, path: str, order: str, rows: int) -> None:
    """Text in folders of `rows` consecutive records each."""
    from readloom.operators.route import even_chunks

    n = max(1, -(-df.count() // rows))
    even_chunks(df, order, n).select("chunk", "value").write.partitionBy("chunk").mode("overwrite").text(path)


def save_counts(counted: DataFrame, path: str, ranges: int = 64) -> None:
    """A k-mer count table as Parquet in ranges of k-mers, so that merges and lookups of k-mers prune row groups."""
    counted.repartitionByRange(ranges, "kmer").sortWithinPartitions("kmer").write.mode("overwrite").parquet(path)


def write_lines(df: DataFrame, path: str, value: str = "value", order: list[str] | None = None, codec: str = "none") -> None:
    """One text file a partition, named part-00000 and on, compressed as the codec says: none, gz, bz2, xz, lzma or zst (the suffix of the files).

    With order the files hold the rows in that order, one after another: ranges of the order are the partitions, sorted.
    """
    from readloom.sources.files import register

    register(df.sparkSession)
    out = df.select(F.col(value).cast("string").alias("value"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order or [])])
    if order:
        keys = [f"__o{i}" for i in range(len(order))]
        out = out.repartitionByRange(*keys).sortWithinPartitions(*keys)
    out.select("value").write.format("readloom_lines").option("codec", codec).mode("overwrite").save(path)
