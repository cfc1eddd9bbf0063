"""Base and quality expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_code(c: Column) -> Column:
    """A C G T in either case as 0..3, anything else -1."""
    return F.when(F.length(c) == 1, F.instr(F.lit("ACGT"), F.upper(c)) - 1).otherwise(-1)


def reverse_complement(s: Column) -> Column:
    """Case is kept, other characters are kept."""
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def strict_reverse_complement(s: Column) -> Column:
    """Upper case; null if there is anything but A C G T."""
    u = F.upper(s)
    return F.when(u.rlike("^[ACGT]*$"), F.reverse(F.translate(u, "ACGT", "TGCA")))


def canonical(kmer: Column) -> Column:
    """The alphabetically lower of an upper-case k-mer and its reverse complement."""
    return F.least(kmer, F.reverse(F.translate(kmer, "ACGT", "TGCA")))


def gc_count(s: Column) -> Column:
    return F.length(s) - F.length(F.translate(s, "GC", ""))


def decode_quality(text: Column, offset: int = 33) -> Column:
    """Characters to Phred values, clamped to 0..255."""
    return F.transform(F.split(text, ""), lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.ascii(c) - offset)))


def parse_quality(text: Column) -> Column:
    """Blank-separated decimals to Phred values, clamped to 0..255; what is no number is 0."""
    parts = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.coalesce(x.try_cast("int"), F.lit(0)))))


def full_quality(seq: Column, qual: Column, cutoff: int) -> Column:
    """Qualities as long as the sequence: missing or too short ones become the cutoff for every base, longer ones are cut."""
    n = F.length(seq)
    return F.when(qual.isNull() | (F.size(qual) < n), F.array_repeat(F.lit(cutoff), n)).otherwise(F.slice(qual, F.lit(1), n))


def runs(seq: Column, pattern: str) -> Column:
    """Maximal runs of a character class as array<struct<start,stop>>, 0-based, half-open. pattern: e.g. '[ACGTacgt]'."""
    marked = F.regexp_replace(seq, f"(?<={pattern})(?!{pattern})|(?<!{pattern})(?={pattern})", "\u0001")
    pieces = F.filter(F.split(marked, "\u0001"), lambda x: x != "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        one = F.array(F.struct(acc["at"].alias("start"), end.alias("stop")))
        return F.struct(end.alias("at"), F.when(piece.rlike(f"^{pattern}"), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def mask_low_quality(seq: Column, qual: Column, cutoff: int) -> Column:
    """Bases of a quality below the cutoff as X; qualities must be as long as the sequence."""
    return F.array_join(F.zip_with(F.split(seq, ""), qual, lambda b, q: F.when(q < cutoff, "X").otherwise(b)), "")
