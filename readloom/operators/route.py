"""Pairs, demultiplexing, splitting and interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.dna import reverse_complement
from readloom.functions.names import mate_base, mate_number
from readloom.operators.order import Ordered


def mates(reads: DataFrame, base: Column | None = None, number: Column | None = None, keep: tuple[str, ...] = ("name", "seq")) -> DataFrame:
    """(base, <keep>1, <keep>2) of reads whose mate is there; of several mates with a number the first by name counts."""
    b, n = base if base is not None else mate_base(F.col("name")), number if number is not None else mate_number(F.col("name"))
    r = reads.select(b.alias("base"), n.alias("__n"), *keep).where("__n in (1, 2)")
    order = F.struct("name") if "name" in keep else F.struct(*keep)
    side = lambda i: F.min_by(F.struct(*keep), F.when(F.col("__n") == i, order)).alias(f"m{i}")
    g = r.groupBy("base").agg(side(1), side(2), F.count_if(F.col("__n") == 1).alias("__a"), F.count_if(F.col("__n") == 2).alias("__b")).where("__a > 0 and __b > 0")
    return g.select("base", *[F.col(f"m{i}")[c].alias(f"{c}{i}") for i in (1, 2) for c in keep])


def pair_duplicates(pairs: DataFrame, length: int, order: str = "base") -> DataFrame:
    """(base, status): 'unique' for the first pair of each key, 'dup' for later ones, 'bad' if a mate is too short or holds other characters.

    The key is the first `length` bases of both mates, canonical over the concatenation.
    """
    key = F.upper(F.concat(F.substring("seq1", 1, length), F.substring("seq2", 1, length)))
    ok = (F.length("seq1") >= length) & (F.length("seq2") >= length) & key.rlike("^[ACGT]*$")
    k = pairs.select("base", order, F.when(ok, F.least(key, reverse_complement(key))).alias("__k")) if order != "base" else pairs.select("base", F.when(ok, F.least(key, reverse_complement(key))).alias("__k"))
    first = k.where("__k is not null").groupBy("__k").agg(F.min(order).alias("__first"))
    status = F.when(F.col("__k").isNull(), "bad").when(F.col(order) == F.col("__first"), "unique").otherwise("dup")
    return k.join(first, "__k", "left").select("base", status.alias("status"))


def singletons(reads: DataFrame, file: str = "file", order: str = "read_idx", base: Column | None = None) -> DataFrame:
    """Reads with neither neighbour (by order in the file) of the same base name; a read without file has no neighbours."""
    r = Ordered(reads.withColumn("__b", base if base is not None else mate_base(F.col("name"))), file, order).with_neighbours("__b", file).df
    beside = lambda side: (F.col(f"__{side}_{file}") == F.col(file)) & F.col(f"__{side}___b").eqNullSafe(F.col("__b"))
    return r.where(~(F.coalesce(beside("prev"), F.lit(False)) | F.coalesce(beside("next"), F.lit(False)))).select(*reads.columns)


def concatenated_pairs(pairs: DataFrame, least: int, linker: str | None = None, insert: int = 48) -> DataFrame:
    """(name, seq): reverse complement of mate 1, `insert` Ns, mate 2, named 'base-<length of mate 1>'; pairs with a mate shorter than `least` are left out.

    With a linker pattern mates are cut before its first match first.
    """
    p = pairs
    if linker:
        cut = lambda c: F.when(F.regexp_instr(c, F.lit(linker)) > 0, F.substring(c, F.lit(1), F.regexp_instr(c, F.lit(linker)) - 1)).otherwise(F.col(c))
        p = p.withColumns({"seq1": cut("seq1"), "seq2": cut("seq2")})
    p = p.where((F.length("seq1") >= least) & (F.length("seq2") >= least))
    return p.select(F.concat("base", F.lit("-"), F.length("seq1").cast("string")).alias("name"), F.concat(reverse_complement(F.col("seq1")), F.lit("N" * insert), F.col("seq2")).alias("seq"))


def demultiplex_exact(pairs: DataFrame, barcodes: DataFrame, width: int = 10) -> DataFrame:
    """pairs with route: the barcode whose bc1 and bc2 are exactly the first `width` bases of both mates, else 'no_match'.

    Barcodes given twice: the lowest name counts.
    """
    b = barcodes.groupBy(F.upper("bc1").alias("__1"), F.upper("bc2").alias("__2")).agg(F.min("name").alias("route"))
    k = pairs.withColumns({"__1": F.upper(F.substring("seq1", 1, width)), "__2": F.upper(F.substring("seq2", 1, width))})
    return k.join(b, ["__1", "__2"], "left").drop("__1", "__2").withColumn("route", F.coalesce("route", F.lit("no_match")))


def _bounded(barcodes: DataFrame, most: int = 10_000) -> list:
    rows = barcodes.select("name", F.upper("bc1").alias("bc1"), F.upper("bc2").alias("bc2")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} barcodes: match by exact position instead (demultiplex_exact)")
    return sorted(rows)


def _alternation(words: set[str]) -> str:
    return "|".join(sorted(words))


def demultiplex_single(reads: DataFrame, barcodes: DataFrame) -> DataFrame:
    """reads with route: one read holds both barcodes, the reverse complement of bc2 after bc1. No hit gives 'no_match', hits of several barcodes
    'multi_match' (overlapping hits all count). The barcode table is a checked parameter (at most 10,000 rows), one literal condition each."""
    rows = _bounded(barcodes)
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    u = F.upper("seq")
    found = F.filter(F.array(*[F.when(u.rlike(f"{r['bc1']}.*{rc(r['bc2'])}"), F.lit(r["name"])) for r in rows]) if rows else F.array().cast("array<string>"), lambda x: x.isNotNull())
    f = F.array_distinct(found)
    return reads.withColumn("__f", f).withColumn("route", F.when(F.size("__f") == 0, "no_match").when(F.size("__f") > 1, "multi_match").otherwise(F.col("__f")[0])).drop("__f")


def demultiplex_pair(pairs: DataFrame, barcodes: DataFrame, head: int | None = 10, retry: bool = False) -> DataFrame:
    """pairs with route: the leftmost bc1 in mate 1, and of that bc1's own bc2 list the leftmost in mate 2. head: only the first bases are searched (None: anywhere);
    retry: if the leftmost bc1 has no bc2, later ones are tried."""
    rows = _bounded(barcodes)
    s1, s2 = (F.upper(c) if head is None else F.upper(F.substring(c, 1, head)) for c in ("seq1", "seq2"))
    hits = []
    for r in rows:
        a, b = F.instr(s1, F.lit(r["bc1"])), F.instr(s2, F.lit(r["bc2"]))
        second = F.when(b > 0, b)
        hits.append(F.when(a > 0, F.struct(a.alias("at1"), F.lit(r["bc1"]).alias("bc1"), F.coalesce(second, F.lit(2**31 - 1)).alias("at2"), F.when(second.isNotNull(), F.lit(r["name"])).alias("name"))))
    if not hits:
        return pairs.withColumn("route", F.lit("no_match"))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull() & (x["name"].isNotNull() if retry else F.lit(True)))
    return pairs.withColumn("route", F.coalesce(F.array_min(found)["name"], F.lit("no_match")))


def route_by_lists(reads: DataFrame, lists: DataFrame) -> DataFrame:
    """(read_idx, name, list_id): each read to the first list that names it, only the first read of a name."""
    first = lists.groupBy("name").agg(F.min("list_id").alias("list_id"))
    one = reads.groupBy("name").agg(F.min("read_idx").alias("read_idx"))
    return one.join(first, "name").select("read_idx", "name", "list_id")


def interleave(left: DataFrame, right: DataFrame, key: str = "n", value: str = "value") -> DataFrame:
    """(ord, value): records of two tables in turns by record number; raises if the numbers of records differ."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} and {b} records")
    j = left.select(key, F.col(value).alias("a")).join(right.select(key, F.col(value).alias("b")), key)
    return j.select(F.explode(F.array(F.struct((F.col(key) * 2).alias("ord"), F.col("a").alias("value")), F.struct((F.col(key) * 2 + 1).alias("ord"), F.col("b").alias("value")))).alias("x")).select("x.*")


def even_chunks(df: DataFrame, order: str, chunks: int) -> DataFrame:
    """df with chunk 0..chunks-1 of consecutive rows in order, the first ones one row longer. Rows are numbered over the ranges of one written table, not in one sorted partition."""
    rows, total = Ordered(df, order).numbered("__n")
    base, rest = divmod(total, chunks)
    cut = rest * (base + 1)
    chunk = F.when(F.col("__n") < cut, F.expr(f"__n div {base + 1}")).otherwise(F.expr(f"{rest} + (__n - {cut}) div {max(base, 1)}"))
    return rows.withColumn("chunk", chunk.cast("bigint")).drop("__n")


def pack_files(sizes: dict[str, int], bins: int, trials: int = 10) -> list[list[str]]:
    """Files into bins of near equal total size, largest first; the trial with the least variance wins (driver-side: a list of files)."""
    import random

    best, least = [], None
    for t in range(trials):
        order = sorted(sizes, key=lambda f: (-sizes[f], f))
        if t:
            r = random.Random(t)
            order.sort(key=lambda f: -sizes[f] * (1 + 0.1 * r.random()))
        out, total = [[] for _ in range(bins)], [0] * bins
        for f in order:
            i = total.index(min(total))
            out[i].append(f)
            total[i] += sizes[f]
        mean = sum(total) / bins
        var = sum((x - mean) ** 2 for x in total)
        if least is None or var < least:
            best, least = out, var
    return best
