"""Read names: forms of several instruments, pairs, libraries, and the quality offset of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality_offset(texts: DataFrame, column: str) -> DataFrame:
    """(quality_offset) of quality text, judged by all rows: 33 or 64, null if ambiguous or out of range."""
    codes = texts.select(F.filter(F.transform(F.split(column, ""), F.ascii), lambda c: c > 0).alias("c"))
    m = codes.agg(F.min(F.array_min("c")).alias("lo"), F.max(F.array_max("c")).alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    return m.select(F.when((lo > 63) & (hi < 77), F.lit(None)).when((lo > 32) & (hi < 77), 33).when((lo > 63) & (hi < 115), 64).alias("quality_offset"))


def without_trace_id(header: Column) -> Column:
    """The header without its first word."""
    return F.regexp_replace(header, r"^\S+\s+", "")


def illumina_short(name: Column) -> Column:
    """'inst:run:flow:lane:tile:x:y 1:N:0:TAG' as 'lane_tile_x_y...-R1': colons become underscores, the mate number a suffix; other names stay."""
    head, mate = F.substring_index(name, " ", 1), F.regexp_extract(name, r"^\S+ ([12]):", 1)
    return F.when(mate != "", F.concat(F.translate(head, ":", "_"), F.lit("-R"), mate)).otherwise(name)


def prep_name(name: Column) -> Column:
    """Name for read preparation: ':', '#' and '-' as '_', the mate as '/1' or '/2' from '/n', ' n:' or a trailing ':n'; null if there is no mate."""
    mate = F.coalesce(*[F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in (r"/([12])$", r"^\S+ ([12]):", r":([12])$")])
    base = F.regexp_replace(F.regexp_replace(F.substring_index(name, " ", 1), "/[12]$", ""), ":[12]$", "")
    return F.when(mate.isNotNull(), F.concat(F.translate(base, ":#-", "___"), F.lit("/"), mate))


def trimmed_subread(name: Column, left: Column, right: Column) -> Column:
    """'movie/hole/a_b' after trimming: a + left, b - right; other names stay."""
    p = r"^(.*/)(\d+)_(\d+)$"
    a, b = F.regexp_extract(name, p, 2).try_cast("bigint"), F.regexp_extract(name, p, 3).try_cast("bigint")
    return F.when(name.rlike(p), F.concat(F.regexp_extract(name, p, 1), (a + left).cast("string"), F.lit("_"), (b - right).cast("string"))).otherwise(name)


def hole(name: Column) -> Column:
    """Hole number of 'movie/hole/...'; null for other names."""
    return F.regexp_extract(name, r"^[^/]+/(\d+)(/|$)", 1).try_cast("bigint")


def well_row(well: Column) -> Column:
    return F.shiftright(well, 16)


def well_column(well: Column) -> Column:
    return well.bitwiseAND(F.lit(65535))


def parsed_name(name: Column) -> Column:
    """struct<kind, template, well, direction> by the first form that fits: movie ('m..._.../hole/...'), Illumina ('a:b:c:d:x:y:z/1'), plate ('<plate>P<well><clone>.F|R'),
    base-36 trace ('<6 letters><base 36 well>.x|y<n>'), other. Direction is F or R, '' if unknown; a base-36 well is decimal."""
    forms = [
        ("movie", r"^(m[^/]+)/(\d+)/(ccs|\d+_\d+)$", 1, F.regexp_extract(name, r"^m[^/]+/(\d+)/", 1), F.lit("")),
        ("illumina", r"^([A-Za-z0-9]+:\d+:[A-Za-z0-9]+:\d+:\d+:\d+:\d+)/([12])$", 1, F.regexp_extract(name, r":(\d+:\d+:\d+)/", 1), F.when(name.endswith("/1"), "F").otherwise("R")),
        ("plate", r"^([A-Z]{2}\d{2})P(\d+)([a-z])\.([FR])$", 1, F.regexp_extract(name, r"P(\d+[a-z])\.", 1), F.right(name, F.lit(1))),
        ("trace", r"^([A-Z]{2}\d{4})([0-9A-Z]+)\.([xy])\d+$", 1, F.conv(F.regexp_extract(name, r"^[A-Z]{2}\d{4}([0-9A-Z]+)\.", 1), 36, 10), F.when(name.contains(".x"), "F").otherwise("R")),
    ]
    out = F.struct(F.lit("other").alias("kind"), name.alias("template"), F.lit("").alias("well"), F.lit("").alias("direction"))
    for kind, pattern, group, well, direction in reversed(forms):
        out = F.when(name.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(name, pattern, group).alias("template"), well.alias("well"), direction.alias("direction"))).otherwise(out)
    return out


def mate_base(name: Column) -> Column:
    """The name both mates share: without '/1', '/2', '-R1', '-R2', '.F', '.R', '.x<n>', '.y<n>'."""
    return F.regexp_replace(name, r"(/[12]|-R[12]|\.[FR]|\.[xy]\d+)$", "")


def mate_number(name: Column) -> Column:
    """1 or 2; null if the name tells nothing."""
    return F.when(name.rlike(r"(/1|-R1|\.F|\.x\d+)$"), 1).when(name.rlike(r"(/2|-R2|\.R|\.y\d+)$"), 2)


def library(name: Column) -> Column:
    """Library of a name: the movie, the instrument and run, or the plate or trace prefix."""
    return F.coalesce(*[F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in (r"^(m\d+)_", r"^([A-Za-z0-9]+:\d+):", r"^([A-Z]{2}\d{2})P\d", r"^([A-Z]{2}\d{2})")])


def words(line: Column) -> Column:
    """Blank-separated words, empties dropped."""
    return F.filter(F.split(line, r"\s+"), lambda x: x != "")


def exact_fields(line: Column, delimiter: str) -> Column:
    """Fields between single delimiters, empties kept."""
    return F.split(line, f"\\Q{delimiter}\\E", -1)


def with_suffix(text: Column) -> Column:
    """Number with a binary suffix k, m or g as bigint; null if it is none."""
    n = F.regexp_extract(text, r"^(\d+)[kmgKMG]?$", 1).try_cast("bigint")
    power = F.when(F.lower(F.right(text, F.lit(1))) == "k", 10).when(F.lower(F.right(text, F.lit(1))) == "m", 20).when(F.lower(F.right(text, F.lit(1))) == "g", 30).otherwise(0)
    return (n * F.pow(F.lit(2), power)).cast("bigint")


def thousands(n: Column) -> Column:
    """Whole number with separators."""
    return F.format_number(n, 0)


def pretty_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns times the least power of ten that brings their maximum to at least 0.1, and that power as `scale`."""
    top = F.array_max(F.array(*[F.max(c) for c in columns]))
    power = df.agg(top.alias("m")).select(F.when(F.col("m") > 0, F.greatest(F.lit(0), F.ceil(-F.log10("m") - 1))).otherwise(0).alias("scale")).first()[0]
    return df.withColumns({c: F.col(c) * 10.0**power for c in columns}).withColumn("scale", F.lit(int(power)))


def direction_hint(name: Column) -> Column:
    """struct<library_hint, direction, pair_key> by the first fitting form: 1 '/1 /2', 2 '-R1 -R2', 3 '.F .R', 4 '.x<n> .y<n>'; hint 0 if none fits."""
    forms = [(1, r"^(.*)/([12])$"), (2, r"^(.*)-R([12])$"), (3, r"^(.*)\.([FR])$"), (4, r"^(.*)\.([xy])\d+$")]
    out = F.struct(F.lit(0).alias("library_hint"), F.lit("").alias("direction"), name.alias("pair_key"))
    for hint, p in reversed(forms):
        d = F.when(F.regexp_extract(name, p, 2).isin("1", "F", "x"), "F").otherwise("R")
        out = F.when(name.rlike(p), F.struct(F.lit(hint).alias("library_hint"), d.alias("direction"), F.regexp_extract(name, p, 1).alias("pair_key"))).otherwise(out)
    return out


def joined_n_splits(records: DataFrame) -> DataFrame:
    """Reads (file, read_idx, name, seq, qual) with the pieces of N-split reads joined: a record named 'n<a>-<b>:<c>.<length>.<quality>' adds so many Ns of that quality and its own
    sequence to the read before it in the file."""
    from readloom.operators.order import Ordered

    p = r"^n\d+-\d+:\d+\.(\d+)\.(\d+)"
    more = F.col("name").rlike(p)
    n, q = F.regexp_extract("name", p, 1).try_cast("int"), F.regexp_extract("name", p, 2).try_cast("int")
    r = Ordered(records.select("file", "read_idx", "name", "seq", "qual"), "file", "read_idx").running((~more).cast("int"), "__g")
    piece = F.struct("read_idx", F.when(more, F.concat(F.repeat(F.lit("N"), n), "seq")).otherwise(F.col("seq")).alias("s"), F.when(more, F.concat(F.array_repeat(q, n), "qual")).otherwise(F.col("qual")).alias("q"), F.when(~more, F.col("name")).alias("name"))
    g = r.groupBy("file", "__g").agg(F.array_sort(F.collect_list(piece)).alias("p"))  # the pieces of one read
    return g.select("file", F.col("p")[0]["read_idx"].alias("read_idx"), F.col("p")[0]["name"].alias("name"), F.array_join(F.transform("p", lambda x: x["s"]), "").alias("seq"), F.flatten(F.transform("p", lambda x: x["q"])).alias("qual"))
