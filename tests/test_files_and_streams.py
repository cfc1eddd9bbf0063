import gzip
import lzma
import random

import pytest
from pyspark.sql import functions as F

from readloom.sources import files, text


@pytest.fixture(scope="module")
def records():
    rnd = random.Random(4)
    out = []
    for i in range(300):
        n = rnd.choice([0, 1, 30, 130])
        out.append((f"r{i}", None if i % 3 else f"c {i}", "".join(rnd.choice("ACGTN") for _ in range(n)), [rnd.choice([31, 0, 40]) for _ in range(n)]))
    return out


def got(df):
    return [(r.name, r.comment, r.seq, r.qual) for r in df.orderBy("file", "read_idx").collect()]


@pytest.mark.parametrize("split", [200, 1 << 20])
def test_fastq_and_fasta(spark, tmp_path, records, split):
    files.register(spark)
    head = lambda m, n, c: f"{m}{n}" + (f" {c}" if c else "")
    fq = "".join(f"{head('@', n, c)}\n{s}\n+\n{''.join(chr(q + 33) for q in ql)}\n" for n, c, s, ql in records)
    fa = "".join(head(">", n, c) + "\n" + "".join(s[i : i + 50] + "\n" for i in range(0, len(s), 50)) for n, c, s, _ in records)
    (tmp_path / "a.fastq").write_text(fq)
    (tmp_path / "a.fasta").write_text(fa)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(fq)
    with lzma.open(tmp_path / "b.fasta.xz", "wt") as f:
        f.write(fa)
    for fmt, name in (("readloom_fastq", "a.fastq"), ("readloom_fastq", "b.fastq.gz")):
        assert got(spark.read.format(fmt).option("splitBytes", split).load(str(tmp_path / name))) == records
    for name in ("a.fasta", "b.fasta.xz"):
        assert got(spark.read.format("readloom_fasta").option("splitBytes", split).load(str(tmp_path / name))) == [(n, c, s, None) for n, c, s, _ in records]


def test_bam_round_trip(spark, tmp_path, records):
    files.register(spark)
    df = spark.createDataFrame([(n, s, q, i, 0, len(s), 3) for i, (n, _, s, q) in enumerate(records)], "full_name string, seq string, qual array<int>, hole_number bigint, q_start bigint, q_end bigint, num_passes bigint")
    wide = df.select("full_name", F.lit(0).alias("flag"), F.lit(None).cast("string").alias("ref_name"), F.lit(0).cast("bigint").alias("pos"), "seq", "qual", "hole_number", "q_start", "q_end", "num_passes")
    wide.repartition(3).write.format("readloom_bam").mode("overwrite").save(str(tmp_path / "bam"))
    back = spark.read.format("readloom_bam").load(str(tmp_path / "bam"))
    assert sorted(map(tuple, back.select(df.columns).collect())) == sorted((n, s, q, i, 0, len(s), 3) for i, (n, _, s, q) in enumerate(records))


def test_blast_and_compact(spark, tmp_path):
    files.register(spark)
    (tmp_path / "x.blast").write_text(
        "Query= q1 some\n\n>t1 x\n          Length = 80\n\n Score = 30 bits (1)\n Identities = 9/10 (90%)\n Strand = Plus / Minus\n\n"
        "Query: 12 acgta 8\n          |||||\nSbjct: 1  acgtt 5\n\nQuery: 7 gg 6\n         ||\nSbjct: 6 gg 7\n\n\n Score = 20 bits (1)\n Identities = 5/5 (100%)\n Strand = Plus / Plus\n\nQuery: 1 acgta 5\n         |||||\nSbjct: 1 acgta 5\n\n\n"
    )
    rows = [tuple(r) for r in spark.read.format("readloom_blast").load(str(tmp_path / "x.blast")).collect()]
    assert rows == [("q1", "t1", 80, 9, 30, 6, 12, 7, 1, "cctacgt", "ccaacgt"), ("q1", "t1", 80, 5, 20, 1, 5, 1, 5, "acgta", "acgta")]
    names = files.MATCH_ARROW.names
    (tmp_path / "x.match").write_text("=q1\n" + "".join(files.compact_match(dict(zip(names, r, strict=True))) for r in rows))
    assert [tuple(r) for r in spark.read.format("readloom_match").load(str(tmp_path / "x.match")).collect()] == rows


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT" * 20, [40] * 80, 1), ("b", "AC", [2, 3], 2)], "name string, seq string, qual array<int>, mate int")
    text.write_fasta(df, str(tmp_path / "fa"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "fa")).collect()) == sorted([">a", ("ACGT" * 20)[:50], ("ACGT" * 20)[50:], ">b", "AC"])
    text.write_fastq(df, str(tmp_path / "fq"), by=["mate"], compression="gzip")
    assert spark.read.text(str(tmp_path / "fq" / "mate=2")).collect()[-1].value == "#$"
    text.write_quality(df, str(tmp_path / "q"), most=30)
    assert "30" in spark.read.text(str(tmp_path / "q")).collect()[1].value
    assert "<WELL_ID>" in text.trace_descriptions(df, {"CENTER_NAME": "x"}).first().value


def test_streams(spark, tmp_path):
    from readloom.operators.kmers import windows
    from readloom.streaming import reads as S

    rows = [(f"p{i // 2}/{i % 2 + 1}", "ACGTACGTAA"[i % 5 :], f"2031-01-01 00:{i % 60:02d}:00", "f") for i in range(40)] + [("lone/1", "ACGT", "2031-01-01 00:01:00", "f"), ("last/1", "ACGT", "2031-01-02 00:00:00", "f")]
    df = spark.createDataFrame(rows, "name string, seq string, at string, file string").withColumn("at", F.to_timestamp("at"))
    df.limit(20).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    df.subtract(df.limit(20)).coalesce(1).write.parquet(str(tmp_path / "in/2"))
    src = S.arriving(spark, str(tmp_path / "in/*"), df.schema, 1)
    q = S.running_counts(src, 4).writeStream.outputMode("complete").format("memory").queryName("kc").start()
    m = S.matched_mates(src, "at").writeStream.outputMode("append").format("memory").queryName("mm").start()
    for x in (q, m):
        x.processAllAvailable()
    want = {r.kmer: r["count"] for r in windows(df, 4, []).groupBy("kmer").count().collect()}
    assert {r.kmer: r.cnt for r in spark.table("kc").collect()} == want
    pairs = spark.table("mm").collect()
    assert {r.base for r in pairs if r.status == "pair"} == {f"p{i}" for i in range(20)}
    for x in (q, m):
        x.stop()
    seen = []
    w = S.fan_out(src, [lambda b, n: seen.append(b.count()), lambda b, n: b.write.mode("append").parquet(str(tmp_path / "copy"))], str(tmp_path / "ck")).start()
    w.processAllAvailable()
    w.stop()
    assert sum(seen) == len(rows) == spark.read.parquet(str(tmp_path / "copy")).count()


@pytest.mark.parametrize("split", [20_000, 1 << 22])
def test_bam_in_ranges(spark, tmp_path, split):
    """Small ranges of several files: every record once, also records longer than many blocks."""
    files.register(spark)
    rnd = random.Random(9)
    rows = []
    for i in range(1500):
        n = rnd.choice([0, 5, 100, 400] if i % 500 else [200_000])
        rows.append((f"m/{i}/ccs", "".join(rnd.choice("ACGT") for _ in range(n)), [rnd.randrange(60) for _ in range(n)], i, 0, n, 3))
    df = spark.createDataFrame(rows, "full_name string, seq string, qual array<int>, hole_number bigint, q_start bigint, q_end bigint, num_passes bigint")
    wide = df.select("full_name", F.lit(0).alias("flag"), F.lit(None).cast("string").alias("ref_name"), F.lit(0).cast("bigint").alias("pos"), "seq", "qual", "hole_number", "q_start", "q_end", "num_passes")
    wide.repartition(2).write.format("readloom_bam").mode("overwrite").save(str(tmp_path / "bam"))
    back = spark.read.format("readloom_bam").option("splitBytes", split).load(str(tmp_path / "bam"))
    assert sorted((r.full_name, r.seq, r.qual) for r in back.collect()) == sorted(r[:3] for r in rows)
    if split == 20_000:
        assert back.rdd.getNumPartitions() > 20


def test_uris(spark, tmp_path, records):
    files.register(spark)
    (tmp_path / "a.fasta").write_text("".join(f">{n}\n{s}\n" for n, _, s, _ in records))
    (tmp_path / "b.fasta").write_text(">x\nAC\n")
    for path in (f"file://{tmp_path}/a.fasta", f"file://{tmp_path}/a*.fasta"):
        assert [(r[0], r[2]) for r in got(spark.read.format("readloom_fasta").option("splitBytes", 300).load(path))] == [(n, s) for n, _, s, _ in records]
    assert spark.read.format("readloom_fasta").load(f"file://{tmp_path}").count() == len(records) + 1


def test_byte_reader():
    import io

    from readloom.sources.bytes import ByteReader

    for size in (1, 3, 100):
        r = ByteReader(io.BytesIO(b"ab\ncd||ef|g||\nlast"), size)
        assert (r.peek(2), r.line(), r.line(b"||"), r.skip(1), r.read(2), r.line(b"||"), r.skip_line(), r.line(), r.line(), r.read(1), r.peek()) == (b"ab", b"ab", b"cd", 1, b"f|", b"g", True, b"last", None, b"", b"")
        assert ByteReader(io.BytesIO(b"abc"), size).skip(9) == 3 and ByteReader(io.BytesIO(b""), size).skip_line() is False


def lzw(data: bytes, widest: int = 12, clear_at: int | None = None) -> bytes:
    """A .Z writer for the tests."""
    out, bits, n = bytearray(b"\x1f\x9d" + bytes([128 | widest])), 0, 0
    state = {"width": 9, "codes": 0}

    def put(code):
        nonlocal bits, n
        bits |= code << n
        n += state["width"]
        state["codes"] += 1
        while n >= 8:
            out.append(bits & 255)
            bits >>= 8
            n -= 8

    def fill_group():
        while state["codes"] % 8:
            put(0)

    table = {bytes([i]): i for i in range(256)}
    free, w = 257, b""
    for i, c in enumerate(data):
        x = w + bytes([c])
        if x in table:
            w = x
            continue
        put(table[w])
        if free < 1 << widest:
            table[x] = free
            free += 1
            if free > 1 << state["width"] and state["width"] < widest:
                fill_group()
                state.update(width=state["width"] + 1, codes=0)
        if clear_at and i and i % clear_at == 0:
            put(256)
            fill_group()
            state.update(width=9, codes=0)
            table, free = {bytes([i]): i for i in range(256)}, 257
        w = bytes([c])
    if w:
        put(table[w])
    if n:
        out.append(bits & 255)
    return bytes(out)


@pytest.mark.parametrize("clear_at", [None, 3000])
def test_uncompress(tmp_path, clear_at):
    from readloom.sources.bytes import uncompress

    rnd = random.Random(3)
    for data in (b"", b"a", b"aaaaaaaaaaaaa", bytes(rnd.choice(b"ACGTN\n") for _ in range(40_000)), bytes(rnd.randrange(256) for _ in range(9000))):
        assert uncompress(lzw(data, 12, clear_at)) == data
    (tmp_path / "x.fasta.Z").write_bytes(lzw(b">a\nACGT\n"))
    with files.opened(str(tmp_path / "x.fasta.Z")) as f:
        assert f.read() == b">a\nACGT\n"
    with pytest.raises(ValueError, match="no .Z"):
        uncompress(b"plain")
