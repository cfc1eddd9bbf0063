"""Search: k-mer indexed reads, positions in a reference, exact loci."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.arrow import gathered
from readloom.functions.packed import Batch
from readloom.functions.reads import numbered
from readloom.operators import kmers as K
from readloom.operators.order import Ordered
from readloom.session import written


def _texts(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(text_id, seq) of the distinct lists of sequences that a key has, and (text_id, key) of every key; text_id is the lowest key, seq the list's sequences with N between them."""
    lists = rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.upper("seq"))), "N").alias("seq")).select(key, "seq", F.xxhash64("seq").alias("h1"), F.xxhash64(F.lit(1), "seq").alias("h2"))
    ids = lists.groupBy("h1", "h2").agg(F.min(key).alias("text_id"), F.min_by("seq", key).alias("seq"))
    copies = lists.select(key, "h1", "h2").join(ids.select("h1", "h2", "text_id"), ["h1", "h2"]).select("text_id", key)
    return ids.select("text_id", "seq"), copies


class ReadIndex:
    """A k-mer index of reads, kept as tables: posted (kmer, text_id, n) with one text for all reads of the same sequences, copies (text_id, read_id) and sizes (text_id, kmers).

    k-mers are keys (packed words for k <= 32), reads and queries have bigint ids.
    """

    def __init__(self, posted: DataFrame, k: int, copies: DataFrame | None = None):
        """posted: (kmer, read_id, n), or (kmer, text_id, n) with copies; kmer as keys."""
        self.k = k
        self.posted = posted if copies is not None else posted.withColumnRenamed("read_id", "text_id")
        self.copies = copies if copies is not None else posted.select(F.col("read_id").alias("text_id"), "read_id").distinct()
        self.sizes = self.posted.groupBy("text_id").agg(F.sum("n").alias("kmers"))
        self.settings = {"most_hits": None, "least_value": 0.0, "by": "query"}

    @property
    def postings(self) -> DataFrame:
        """(kmer, read_id, n) of every read."""
        return K.spell(self.posted.join(self.copies, "text_id").select("kmer", "read_id", "n"), self.k)

    @classmethod
    def build(cls, reads: DataFrame, k: int = 24) -> ReadIndex:
        """Reads: (read_id bigint, seq); a read's rows are one text. The texts' postings are written once, for searches, sizes and caps alike."""
        texts, copies = _texts(reads.where("read_id is not null"), "read_id")
        posted, _ = written(K.read_kmers(texts, k, "text_id").select("kmer", F.col("id").alias("text_id"), "n"), "postings")
        return cls(posted, k, written(copies, "copies")[0])

    @classmethod
    def load(cls, spark, path: str, k: int) -> ReadIndex:
        """The index of postings that save() wrote."""
        return cls(K.keyed(spark.read.parquet(path), k), k)

    def save(self, path: str, buckets: int = 64) -> None:
        """Postings as Parquet, in ranges of k-mers, so that a lookup reads few row groups."""
        self.postings.repartitionByRange(buckets, "kmer").sortWithinPartitions("kmer").write.mode("overwrite").parquet(path)

    def set(self, **settings) -> ReadIndex:
        """Change settings: most_hits (None: no cap), least_value, by ('query' or 'read')."""
        if unknown := set(settings) - set(self.settings):
            raise ValueError(f"unknown settings {sorted(unknown)}")
        self.settings.update(settings)
        return self

    def search(self, queries: DataFrame) -> DataFrame:
        """(query, read_id, hits, value) for queries (query, seq): hits is the sum over the query's k-mers (with multiplicity) of their occurrences in the read.

        Every k-mer counts, unless most_hits is set: then k-mers with more occurrences are skipped (that cap is the search's own option, an index is not thinned by it). value is
        hits over the k-mers of the query, or of the read (by='read'); rows with value >= least_value. Same queries and same reads are compared once; the pairs are spread over
        their copies at the end.
        """
        texts, same = _texts(queries.where("query is not null"), "query")
        q, _ = written(K.read_kmers(texts, self.k, "text_id").select(F.col("id").alias("q_id"), "kmer", F.col("n").alias("m")), "asked")
        size = q.groupBy("q_id").agg(F.sum("m").alias("q_kmers"))
        asked = q
        if self.settings["most_hits"] is not None:
            weights = self.copies.groupBy("text_id").agg(F.count("*").alias("w"))
            held = self.posted.join(q.select("kmer").distinct(), "kmer", "left_semi").join(weights, "text_id")
            asked = q.join(held.groupBy("kmer").agg(F.sum(F.col("n") * F.col("w")).alias("all")).where(F.col("all") > self.settings["most_hits"]).select("kmer"), "kmer", "left_anti")
        hits = asked.join(self.posted, "kmer").groupBy("q_id", "text_id").agg(F.sum(F.col("m") * F.col("n")).alias("hits"))
        base = hits.join(size, "q_id").withColumn("__d", F.col("q_kmers")) if self.settings["by"] == "query" else hits.join(self.sizes, "text_id").withColumn("__d", F.col("kmers"))
        out = base.withColumn("value", F.round(F.col("hits") / F.col("__d"), 6)).where(F.col("value") >= self.settings["least_value"]).select("q_id", "text_id", "hits", "value")
        return out.join(same.withColumnRenamed("text_id", "q_id"), "q_id").join(self.copies, "text_id").select("query", "read_id", "hits", "value")

    def ranked(self, queries: DataFrame) -> DataFrame:
        """search() with rank_no by hits descending, read_id ascending."""
        w = Window.partitionBy("query").orderBy(F.desc("hits"), "read_id")
        return self.search(queries).withColumn("rank_no", F.row_number().over(w).cast("bigint"))

    def search_text(self, seq: str) -> DataFrame:
        """(read_id, hits, value, rank_no) for one sequence."""
        spark = self.posted.sparkSession
        return self.ranked(spark.createDataFrame([(0, seq)], "query bigint, seq string")).drop("query")

    def msearch(self, path: str) -> DataFrame:
        """ranked() for a text file of sequences, one a line; query is the line's number in its file's order (from 0), empty lines ask nothing."""
        from readloom.sources.files import register

        spark = self.posted.sparkSession
        register(spark)
        lines = spark.read.format("readloom_lines").load(path)
        return self.ranked(lines.select(F.col("line_no").alias("query"), F.trim("value").alias("seq")).where("seq <> ''"))

    def show(self) -> dict:
        """The settings, k, and the sizes of the index."""
        n = self.posted.agg(F.count_distinct("kmer").alias("kmers"), F.sum("n").alias("occurrences")).first()
        return {**self.settings, "k": self.k, "kmers": n["kmers"], "occurrences": n["occurrences"] or 0, "reads": self.copies.count()}

    def write(self, queries: DataFrame, path: str, codec: str = "none") -> None:
        """ranked() as tab-separated lines in order of query and rank."""
        from readloom.sources.text import write_lines

        found = self.ranked(queries).select("query", "rank_no", F.concat_ws("\t", "query", "read_id", "hits", "value").alias("value"))
        write_lines(found, path, order=["query", "rank_no"], codec=codec)

    @classmethod
    def help(cls) -> str:
        """What the index can do, a line each."""
        public = [n for n in vars(cls) if not n.startswith("_") and callable(getattr(cls, n))]
        return "\n".join(f"{n}: {(getattr(cls, n).__doc__ or '').strip().splitlines()[0] if getattr(cls, n).__doc__ else ''}" for n in public)

    def histogram(self) -> DataFrame:
        """(size, n_kmers): how many k-mers have so many occurrences."""
        return K.postings_histogram(self.postings)


def first_positions(reference: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(kmer, id, pos): read number and position of the first occurrence of every canonical k-mer (a key) in order of file, read and position, and the numbered reads with __id.

    A k-mer's first position needs no text in the shuffle: reads are numbered in order, and their k-mers combined per read.
    """
    r = numbered(reference.select("file", "read_idx", "name", "seq"), "file", "read_idx")
    return K.read_kmers(r, k, "__id").groupBy("kmer").agg(F.min_by("pos", "id").alias("pos"), F.min("id").alias("id")).select("kmer", "id", "pos"), r


def hits(reference: DataFrame, target: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, pos) of the reference's k-mers that the target's reads hold too, at their first position, and the numbered reference reads."""
    first, r = first_positions(reference, k)
    return first.join(K.key_counts(target, k).select("kmer"), "kmer", "left_semi").select("id", "pos"), r


def located(found: DataFrame, numbered_reads: DataFrame, *columns: str) -> DataFrame:
    """columns of the numbered reads, and what was found in them."""
    return found.join(numbered_reads.select(F.col("__id").alias("id"), *columns), "id").select(*columns, *[c for c in found.columns if c != "id"])


def _ranges(batches: Iterator[pa.RecordBatch], k: int, reach: int) -> Iterator[pa.RecordBatch]:
    """Ranges of each row's positions (id, list): a range goes on while the next position is at most `reach` further."""
    for t in batches:
        lists = t.column(1)
        row, pos = np.repeat(np.arange(t.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy().astype(np.int64)
        order = np.lexsort((pos, row))
        row, pos = row[order], pos[order]
        new = np.ones(len(pos), bool)
        new[1:] = (row[1:] != row[:-1]) | (pos[1:] - pos[:-1] > reach)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(pos)) - 1 if len(at) else at
        yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(row[at])), pa.array(pos[at]), pa.array(pos[last] + k)], names=["id", "start", "stop"])


def merge_hits(found: DataFrame, k: int, touching: bool = False) -> DataFrame:
    """(id, start, stop): ranges of hits at adjacent positions (stop is the last start + k); touching also joins ranges that overlap or touch.

    found: (id bigint, pos), repeated rows count once. A read's positions, at most one a base, are one row.
    """
    lists = found.groupBy("id").agg(F.collect_list("pos").alias("pos"))
    return lists.mapInArrow(lambda it: _ranges(it, k, k if touching else 1), "id bigint, start bigint, stop bigint")


def squashed_reads(found: DataFrame, numbered_reads: DataFrame, k: int) -> DataFrame:
    """(file, read_idx, name, start, stop, seq, offset): the stretches of reads that hold any of the found k-mers (id, pos), and nothing else, in order; offset is where a
    stretch begins in all of them laid end to end. Sequence that no k-mer uses is gone."""
    pieces = located(merge_hits(found, k, touching=True), numbered_reads, "file", "read_idx", "name", "seq")
    cut = pieces.select("file", "read_idx", "name", "start", "stop", F.substring("seq", (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")).alias("seq"))
    size = F.col("stop") - F.col("start")
    return Ordered(cut, "file", "read_idx", "start").running(size, "__end").withColumn("offset", F.col("__end") - size).drop("__end")


def offsets_to_reads(offsets: DataFrame, reads: DataFrame, offset: str = "offset") -> DataFrame:
    """offsets with file, read_idx, name and pos: which read of all reads laid end to end (in order of file and read_idx) holds each offset, and where.

    Reads: file, read_idx, name, seq (null counts as empty). Offsets outside, and null ones, are left out. Starts and offsets are put in one order and the
    starts up to each offset counted, so no side is broadcast and no row meets more than its own read.
    """
    n = F.coalesce(F.length("seq"), F.lit(0)).cast("bigint")
    laid = Ordered(reads.where(n > 0).select("file", "read_idx", "name", n.alias("__n")), "file", "read_idx").running(F.col("__n"), "__end")
    starts = written(laid.select("file", "read_idx", "name", "__n", (F.col("__end") - F.col("__n")).alias("__start")), "starts")[0]
    number, _ = Ordered(starts, "__start").numbered("__k")
    keyed, _ = written(offsets.where(F.col(offset) >= 0).withColumn("__id", F.monotonically_increasing_id()), "offsets")
    both = starts.select(F.col("__start").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast("bigint").alias("__id")).unionByName(keyed.select(F.col(offset).cast("bigint").alias("__at"), F.lit(1).alias("__kind"), "__id"))
    upto = Ordered(both, "__at", "__kind").running(1 - F.col("__kind"), "__k").where("__kind = 1").select("__id", "__at", (F.col("__k") - 1).alias("__k"))
    hit = upto.join(number, "__k").where("__at < __start + __n")
    return keyed.join(hit.select("__id", "file", "read_idx", "name", (F.col("__at") - F.col("__start")).alias("pos")), "__id").drop("__id")


def squashed_loci(loci: DataFrame) -> DataFrame:
    """(seq, locus): one row per distinct sequence; loci of it in order as 'id1_id2', joined by ';', each with the sorted parents that hold it. 'NONE' is left out."""
    one = loci.where("seq is not null and seq not in ('NONE', '')").groupBy("seq", F.concat_ws("_", "id1", "id2").alias("id")).agg(F.concat_ws("", F.array_sort(F.collect_set("parent"))).alias("parents"))
    return one.groupBy(F.upper("seq").alias("seq")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("_", "id", "parents"))), ";").alias("locus"))


LOCI_AT_ONCE, BASES_AT_ONCE = 500_000, 50_000_000


def _turned(text: str) -> str:
    return text[::-1].translate(str.maketrans("ACGT", "TGCA"))


def _find(batches: Iterator[pa.RecordBatch], seeds: dict[int, tuple[np.ndarray, np.ndarray]], texts: list[tuple[str, str, str]]) -> Iterator[pa.RecordBatch]:
    """Rows of the last column's texts that hold a wanted text: seeds are looked up as packed words, what follows a seed is compared base by base."""
    sizes = np.array([len(x[0]) for x in texts])
    for t in gathered(batches, "__seq", 1_000_000):
        seqs = t.column("__seq")
        b = Batch(seqs)
        rows, at, which = [], [], []
        for m, (words, owner) in seeds.items():
            ok = np.flatnonzero(b.valid(m))
            if not len(ok):
                continue
            word = b.packed(m)[ok]
            lo, hi = np.searchsorted(words, word, "left"), np.searchsorted(words, word, "right")
            n = hi - lo
            hit = np.repeat(np.arange(len(ok)), n)
            into = np.repeat(lo, n) + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
            rows.append(b.row[ok[hit]])
            at.append(ok[hit] - b.starts[rows[-1]])
            which.append(owner[into])
        if not rows:
            continue
        rows, at, which = (np.concatenate(x) for x in (rows, at, which))
        fits = at + sizes[which] <= b.lengths[rows]
        for i in np.flatnonzero(fits & (sizes[which] > 32)):
            text = texts[which[i]][0]
            fits[i] = seqs[int(rows[i])].as_py()[at[i] : at[i] + len(text)] == text
        rows, at, which = rows[fits], at[fits], which[fits]
        kept = t.drop_columns(["__seq"]).take(pa.array(rows))
        found = [pa.array(at.astype(np.int32)), pa.array([texts[w][2] for w in which], pa.string()), pa.array([texts[w][1] for w in which], pa.string())]
        yield from pa.Table.from_arrays([*kept.columns, *found], names=[*kept.schema.names, "pos", "strand", "locus_seq"]).to_batches()


def find_loci(reads: DataFrame, loci: DataFrame, keep: list[str]) -> DataFrame:
    """keep, pos, strand, locus_seq: exact occurrences of locus sequences of any length in the reads, on either strand (a palindrome on '+').

    The first 32 bases (all, if there are fewer) are looked up as packed words, the rest is compared. The reads are passed over without a shuffle, once for every
    500,000 distinct loci (or 50 million bases of them), so what is sent to the tasks stays bounded however many there are. Case does not matter; null, empty and 'NONE' loci, and loci
    with anything but A C G T, are found nowhere.
    """
    distinct = loci.select(F.upper("seq").alias("seq")).where(F.col("seq").rlike("^[ACGT]+$")).distinct()
    n, bases = distinct.agg(F.count("*"), F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()
    slices = max(1, -(-n // LOCI_AT_ONCE), -(-bases // BASES_AT_ONCE))
    fields = {f.name: f.dataType.simpleString() for f in reads.schema}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in keep] + ["pos int, strand string, locus_seq string"])
    src, out = reads.select(*keep, F.upper("seq").alias("__seq")), []
    for i in range(slices):
        chosen = sorted(r[0] for r in (distinct if slices == 1 else distinct.where(F.pmod(F.xxhash64("seq"), F.lit(slices)) == i)).collect())
        texts = [(x, x, "+") for x in chosen] + [(_turned(x), x, "-") for x in chosen if _turned(x) != x]
        seeds = {}
        for m in sorted({min(len(x[0]), 32) for x in texts}):
            owner = np.array([j for j, x in enumerate(texts) if min(len(x[0]), 32) == m])
            b = Batch(pa.array([texts[j][0][:m] for j in owner]))
            word = b.packed(m)[b.starts]
            order = np.argsort(word, kind="stable")
            seeds[m] = (word[order], owner[order])
        out.append(src.mapInArrow(lambda it, seeds=seeds, texts=texts: _find(it, seeds, texts), schema))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def reads_by_locus(found: DataFrame, most: int = 1000, name: str = "name") -> DataFrame:
    """(locus_seq, part, n_reads, names): the distinct reads of each locus in order of name, at most `most` a row, joined by blanks; parts count from 0.

    A locus that very many reads hold has many rows; its reads are numbered over ranges of the order, so no task gathers them.
    """
    rows, _ = Ordered(found.select("locus_seq", F.col(name).alias("name")).distinct(), "locus_seq", "name").numbered("__n")
    first = rows.groupBy("locus_seq").agg(F.min("__n").alias("__first"))
    part = F.floor((F.col("__n") - F.col("__first")) / most)
    per = rows.join(first, "locus_seq").groupBy("locus_seq", part.alias("part")).agg(F.count("*").alias("n_reads"), F.array_join(F.array_sort(F.collect_list("name")), " ").alias("names"))
    return per
