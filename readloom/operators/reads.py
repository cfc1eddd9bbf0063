"""Per-read operators: duplicate names, pairing with qualities, clipping, filters, extraction, output text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.dna import full_quality, reverse_complement, runs


def first_of_name(reads: DataFrame, file: str = "file", name: str = "name", order: str = "read_idx") -> DataFrame:
    """The first row of each (file, name); later ones are duplicates. A null name is a name of its own kind."""
    first = reads.groupBy(file, name).agg(F.min(order).alias(order))
    on = reads[file].eqNullSafe(first[file]) & reads[name].eqNullSafe(first[name]) & (reads[order] == first[order])
    return reads.join(first, on, "left_semi")


def pair_quality(reads: DataFrame, qualities: DataFrame, cutoff: int) -> DataFrame:
    """Sequences with their qualities by name: missing or too short qualities become the cutoff for every base, longer ones are cut."""
    q = qualities.select("name", F.col("qual").alias("__q"))
    return reads.drop("qual").join(q, "name", "left").withColumn("qual", full_quality(F.col("seq"), F.col("__q"), cutoff)).drop("__q")


def vector_span(seq: Column, qual: Column, cutoff: int = 20, and_n: bool = False, simple: float | None = None) -> Column:
    """struct<start, stop> of the run without X (or N and X) that has most bases of quality >= cutoff; the first of equal ones; null if there is none.

    simple: runs in which one character fills at least ceil(length * simple) bases score 0.
    """
    spans = runs(seq, "[^NXnx]" if and_n else "[^Xx]")

    def score(s: Column) -> Column:
        n = F.size(F.filter(F.slice(qual, s["start"] + 1, s["stop"] - s["start"]), lambda q: q >= cutoff))
        if simple is None:
            return n
        piece = F.substring(F.upper(seq), s["start"] + 1, s["stop"] - s["start"])
        share = F.greatest(*[F.length(piece) - F.length(F.translate(piece, b, "")) for b in "ACGTN"])
        return F.when(share >= F.ceil(F.length(piece) * simple), 0).otherwise(n)

    best = F.array_max(F.transform(spans, lambda s: F.struct(score(s).alias("score"), (-s["start"]).alias("first"), s["stop"].alias("stop"))))
    return F.when(best.isNotNull(), F.struct((-best["first"]).alias("start"), best["stop"].alias("stop")))


def quality_clip(reads: DataFrame, cutoff: int, width: int = 20, min_clip: int = 0, key: str = "name") -> DataFrame:
    """(key, q_start, q_stop): the bases between the first and the last window of `width` bases whose quality sum reaches width * cutoff.

    reads: key, seq, qual, v_start, v_stop (the vector span; qualities outside are not seen). The window that ramps up is partial, its missing bases
    count 0: q_start = max(first - width + 1, v_start, min_clip), q_stop = last + 1; no window gives an empty region (0, 0).
    """
    b = reads.select(key, "v_start", "v_stop", F.posexplode(F.expr("slice(qual, v_start + 1, v_stop - v_start)")).alias("i", "q"))
    w = Window.partitionBy(key).orderBy("i")
    s = b.withColumn("s", F.sum("q").over(w.rowsBetween(-(width - 1), 0))).where(F.col("s") >= width * cutoff)
    g = s.groupBy(key).agg(F.min(F.col("i") + F.col("v_start")).alias("a"), F.max(F.col("i") + F.col("v_start")).alias("b"), F.first("v_start").alias("v"))
    clip = g.select(key, F.greatest(F.col("a") - (width - 1), F.col("v"), F.lit(min_clip)).alias("q_start"), (F.col("b") + 1).alias("q_stop"))
    return reads.select(key).join(clip, key, "left").select(key, F.coalesce("q_start", F.lit(0)).alias("q_start"), F.coalesce("q_stop", F.lit(0)).alias("q_stop"))


def soft_clip(reads: DataFrame, mean: int = 25, width: int = 20, key: str = "name") -> DataFrame:
    """(key, hq_start, hq_stop): from the first to the last full window of `width` bases with a mean quality of at least `mean`; none gives (0, 0)."""
    b = reads.where(F.size("qual") >= width).select(key, F.posexplode("qual").alias("i", "q"))
    w = Window.partitionBy(key).orderBy("i")
    s = b.withColumn("s", F.sum("q").over(w.rowsBetween(-(width - 1), 0))).where((F.col("i") >= width - 1) & (F.col("s") >= mean * width))
    g = s.groupBy(key).agg((F.min("i") - (width - 1)).alias("hq_start"), (F.max("i") + 1).alias("hq_stop"))
    return reads.select(key).join(g, key, "left").select(key, F.coalesce("hq_start", F.lit(0)).alias("hq_start"), F.coalesce("hq_stop", F.lit(0)).alias("hq_stop"))


def linker_clip(reads: DataFrame, pattern: str) -> DataFrame:
    """seq and qual cut before the first match of the linker's pattern (any case); reads without one stay whole."""
    at = F.regexp_instr("seq", F.lit(f"(?i){pattern}"))
    n = F.when(at > 0, at - 1).otherwise(F.length("seq"))
    return reads.withColumns({"seq": F.substring("seq", F.lit(1), n), "qual": F.slice("qual", F.lit(1), n)})


def high_quality_count(qual: Column, least: int = 20, seq: Column | None = None) -> Column:
    """Bases of at least the quality; with seq only plain bases count."""
    if seq is None:
        return F.size(F.filter(qual, lambda q: q >= least))
    both = F.arrays_zip(F.split(seq, "").alias("b"), qual.alias("q"))
    return F.size(F.filter(both, lambda z: (z["q"] >= least) & z["b"].rlike("^[ACGTacgt]$")))


def select_reads(reads: DataFrame, least: int = 0, include: str | None = None, exclude: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Reads of at least `least` (at most `most`) bases whose name matches the pattern and is not in the excluded names."""
    out = reads.where(F.length("seq") >= least)
    if most is not None:
        out = out.where(F.length("seq") <= most)
    if include is not None:
        out = out.where(F.col("name").rlike(include))
    return out if exclude is None else out.join(exclude.select("name").distinct(), "name", "left_anti")


def sub_read(reads: DataFrame, start: Column, stop: Column) -> DataFrame:
    """The bases [start, stop) of each read, named 'name_<start+1> <length>'."""
    stop = F.least(stop, F.length("seq"))
    n = F.greatest(stop - start, F.lit(0))
    return reads.select(F.concat(F.col("name"), F.lit("_"), (start + 1).cast("string"), F.lit(" "), n.cast("string")).alias("name"), F.substring("seq", start + 1, n).alias("seq"), F.slice("qual", start + 1, n).alias("qual"))


def strip_zero_quality(qual: Column) -> Column:
    """Qualities without zeros at either end."""
    good = F.filter(F.transform(qual, lambda q, i: F.when(q > 0, i)), lambda i: i.isNotNull())
    return F.when(F.size(good) == 0, F.array().cast("array<int>")).otherwise(F.slice(qual, F.array_min(good) + 1, F.array_max(good) - F.array_min(good) + 1))


def trim_n(seq: Column) -> Column:
    """Sequence with N runs resolved: N at the ends go; '?NN...' is rejected; '?N...' loses those two and nothing else; otherwise it ends before the first run of
    several Ns if that is its first N, else before its second N. Null if rejected or nothing but N."""
    s = F.regexp_replace(F.regexp_replace(seq, "^N+", ""), "N+$", "")
    rest = F.when(s.rlike("^[^N]*NN"), F.substring_index(s, "N", 1)).otherwise(F.substring_index(s, "N", 2))
    return F.when((s == "") | s.rlike("^[^N]NN"), F.lit(None)).when(s.rlike("^[^N]N"), F.substring(s, F.lit(3), F.length(s))).otherwise(rest)


def by_names(reads: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    out = reads if include is None else reads.join(include.select("name").distinct(), "name", "left_semi")
    return out if exclude is None else out.join(exclude.select("name").distinct(), "name", "left_anti")


def name_options(reads: DataFrame, options: DataFrame) -> DataFrame:
    """Reads kept by a series of include / exclude options; of several that name a read the last one decides, unnamed reads go.

    options: (ord, name, keep boolean).
    """
    last = options.groupBy("name").agg(F.max_by("keep", "ord").alias("keep")).where("keep")
    return reads.join(last.select("name"), "name", "left_semi")


def extract_ranges(reads: DataFrame, ranges: DataFrame) -> DataFrame:
    """(list_id, name, start, stop, seq, beyond): reads cut to ranges (0-based, half-open; stop 0 is to the end), one row per distinct range of an output.

    beyond: the range reaches past the read's end (it is cut there).
    """
    once = ranges.groupBy("list_id", "name", "start", "stop").agg(F.min("ord").alias("ord"))
    j = reads.join(once, "name")
    end = F.when(F.col("stop") == 0, F.length("seq")).otherwise(F.least(F.col("stop"), F.length("seq")))
    return j.select("list_id", "ord", "name", "start", end.cast("bigint").alias("stop"), F.substring(F.col("seq"), F.col("start").cast("int") + 1, F.greatest(F.lit(0), end - F.col("start")).cast("int")).alias("seq"), ((F.col("stop") > F.length("seq")) | (F.col("start") >= F.length("seq"))).alias("beyond"))


def parse_ranges(text: Column) -> Column:
    """'name@a-b,c-d' (1-based, inclusive) as array<struct<name,start,stop>> (0-based, half-open; b = 0 to the end; without '@' the whole read)."""
    name = F.substring_index(text, "@", 1)
    parts = F.split(F.substring(text, F.length(name) + 2, F.length(text)), ",")
    one = lambda p: F.struct(name.alias("name"), (F.substring_index(p, "-", 1).cast("bigint") - 1).alias("start"), F.substring_index(p, "-", -1).cast("bigint").alias("stop"))
    whole = F.array(F.struct(name.alias("name"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("stop")))
    return F.when(text.contains("@"), F.transform(parts, one)).otherwise(whole)


def validate_quality(reads: DataFrame, qualities: DataFrame) -> DataFrame:
    """(name, problem): names with a sequence but no quality, a quality but no sequence, or different lengths."""
    s = reads.select("name", F.length("seq").alias("n"))
    q = qualities.where("qual is not null").select("name", F.size("qual").alias("m"))
    j = s.join(q, "name", "full_outer")
    problem = F.when(F.col("m").isNull(), "no quality").when(F.col("n").isNull(), "no sequence").when(F.col("n") != F.col("m"), "length")
    return j.select("name", problem.alias("problem")).where("problem is not null")


def wrapped(seq: Column, width: int = 50) -> Column:
    """Text in lines of `width` characters; 0 keeps one line."""
    return seq if width == 0 else F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def fasta_record(name: Column, seq: Column, width: int = 50, comment: Column | None = None) -> Column:
    head = F.concat(F.lit(">"), name) if comment is None else F.concat(F.lit(">"), name, F.when(F.trim(comment) != "", F.concat(F.lit(" "), comment)).otherwise(""))
    return F.concat(head, F.lit("\n"), wrapped(seq, width))


def quality_record(name: Column, qual: Column, width: int = 20, most: int | None = None) -> Column:
    """FASTA-style quality record, `width` values a line, values capped at `most`."""
    q = qual if most is None else F.transform(qual, lambda x: F.least(x, F.lit(most)))
    text = F.array_join(F.transform(q, lambda x, i: F.concat(x.cast("string"), F.when((i + 1) % width == 0, "\n").otherwise(" "))), "") if width else F.array_join(q.cast("array<string>"), " ")
    return F.concat(F.lit(">"), name, F.lit("\n"), F.rtrim(F.regexp_replace(text, r"\s+$", "")))


def fastq_record(name: Column, seq: Column, qual: Column) -> Column:
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), F.array_join(F.transform(qual, lambda q: F.char(q + 33)), ""))


def complemented(reads: DataFrame) -> DataFrame:
    return reads.withColumns({"seq": reverse_complement(F.col("seq")), "qual": F.reverse("qual")})


def mend_pair(pairs: DataFrame) -> DataFrame:
    """(name, seq1, seq2, good1, good2) with a failed mate replaced by the reverse complement of the good one."""
    return pairs.withColumns({
        "seq1": F.when(~F.col("good1") & F.col("good2"), reverse_complement(F.col("seq2"))).otherwise(F.col("seq1")),
        "seq2": F.when(F.col("good1") & ~F.col("good2"), reverse_complement(F.col("seq1"))).otherwise(F.col("seq2")),
    })
