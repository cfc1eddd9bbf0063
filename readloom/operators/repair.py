"""Alignment-driven sequence repair: each query sequence is corrected from the sequences matched to it."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import drop_table, written

CONFIRMED = 40  # fixed value: quality of confirmed bases


def homopolymer_trim(qs: str, ss: str) -> tuple[int, int]:
    """Columns [a, b) of an alignment without the end columns inside the first and last run of one base (a run at an end may have lost bases)."""
    a, b = 0, len(qs)
    while a + 1 < b and qs[a] == qs[a + 1]:
        a += 1
    while b - 1 > a and qs[b - 1] == qs[b - 2]:
        b -= 1
    return (min(a + 1, b), max(b - 1, a)) if b - a > 2 else (a, a)


def shift_right(qs: str, ss: str) -> tuple[str, str]:
    """The alignment with each gap moved as far right as its repeat allows."""

    def slide(x: list[str], y: list[str]) -> None:
        i = len(x) - 1
        while i >= 0:
            if x[i] == "-":
                j = i
                while j + 1 < len(x) and x[j + 1] != "-" and y[j + 1] != "-" and y[j] == x[j + 1] == y[j + 1]:
                    x[j], x[j + 1] = x[j + 1], x[j]
                    j += 1
            i -= 1

    q, s = list(qs), list(ss)
    slide(q, s)
    slide(s, q)
    return "".join(q), "".join(s)


def _columns(start: int, qs: str, ss: str) -> list[tuple[int, str]]:
    """(query position, replacement) of every query base of an alignment; inserted bases belong to the base before them."""
    out: list[tuple[int, str]] = []
    p = start
    for a, b in zip(qs, ss, strict=True):
        if a == "-":
            if out:
                out[-1] = (out[-1][0], out[-1][1] + b)
        else:
            out.append((p, "" if b == "-" else b))
            p += 1
    return out


def match_votes(size: int, start: int, a: str, b: str) -> dict[int, str]:
    """What an alignment says of each position of a query of so many bases; other characters than bases say nothing."""
    a, b = shift_right(a.upper(), b.upper())
    lo, hi = homopolymer_trim(a, b)
    cols = dict(_columns(start + sum(c != "-" for c in a[:lo]), a[lo:hi], b[lo:hi]))
    return {p: t for p, t in cols.items() if 0 <= p < size and not t.strip("ACGT")}


def repaired(seq: str, qual: list[int] | None, changes: dict[int, str], confirmed: set[int]) -> tuple[str, list[int], int, int]:
    """(sequence, qualities, changes, confirmed bases) with the changes made and the confirmed positions at quality 40."""
    q = list(qual) if qual is not None and len(qual) == len(seq) else [0] * len(seq)
    out, quals = [], []
    for p, old in enumerate(seq):
        kept = changes.get(p, old)
        kept = old if kept == old.upper() else kept
        out.append(kept)
        quals += [CONFIRMED if p in confirmed else q[p]] * len(kept)
    return "".join(out), quals, len(changes), len(confirmed)


def repair_one(seq: str, qual: list[int] | None, matches: list[tuple[int, str, str]], confirm: int, change: int) -> tuple[str, list[int], int, int]:
    """(sequence, qualities, changes, confirmed bases).

    matches: (start on the query, aligned query, aligned other). Changes are made one at a time, the best supported first (ties: lowest position, then lowest text), if at least `change` matches
    support it and more do than support the query's own base; a match that contradicts a made change has no vote any more, anywhere. A base that at least `confirm` matches agree with
    gets quality 40.
    """
    votes = [match_votes(len(seq), *m) for m in matches]
    at: dict[int, Counter] = defaultdict(Counter)
    for v in votes:
        for p, t in v.items():
            at[p][t] += 1
    bases = [c.upper() for c in seq]
    changes: dict[int, str] = {}
    while True:
        best = None
        for p, c in at.items():
            if p in changes:
                continue
            for t, n in c.items():
                if t != bases[p] and n >= change and n > c[bases[p]] and (best is None or (-n, p, t) < best):
                    best = (-n, p, t)
        if best is None:
            break
        _, p, t = best
        for v in votes:
            if p in v and v[p] != t:
                for x, old in v.items():
                    at[x][old] -= 1
                v.clear()
        bases[p] = changes[p] = t
    return repaired(seq, qual, changes, {p for p, t in enumerate(bases) if p in at and at[p][t] >= confirm})


def deep_changes(sequences: DataFrame, matches: DataFrame, confirm: int, change: int, most_rounds: int = 10_000) -> DataFrame:
    """(query_id, changes array<struct<pos,text>>, confirmed array<int>) of sequences with very many matches, by the same rule as repair_one, over all tasks.

    sequences: query_id, seq; matches: query_id, start, qs, ss. Votes are rows (query, match, position, text); each round takes every sequence's best change from the votes' counts and
    withdraws the matches against it, until no sequence has a change left. A sequence's matches never meet in one task.
    """
    each = matches.join(sequences.select("query_id", F.length("seq").alias("size")), "query_id").select("query_id", F.monotonically_increasing_id().alias("m"), "size", "start", "qs", "ss")

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(x["query_id"], x["m"], p, t) for x in b.to_pylist() for p, t in match_votes(x["size"], int(x["start"]), x["qs"], x["ss"]).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["query_id", "m", "pos", "text"])

    votes, path = written(each.mapInArrow(cast, "query_id string, m bigint, pos int, text string"), "votes")
    base = sequences.select("query_id", F.posexplode(F.split(F.upper("seq"), "")).alias("pos", "base"))
    spark, made, rounds = sequences.sparkSession, None, 0
    while True:
        counts, counts_path = written(votes.groupBy("query_id", "pos", "text").agg(F.count("*").alias("n")), "counts")
        now = base if made is None else base.join(made.select("query_id", "pos", F.col("text").alias("new")), ["query_id", "pos"], "left").select("query_id", "pos", F.coalesce("new", "base").alias("base"), F.col("new").isNotNull().alias("made"))
        own = counts.join(now, ["query_id", "pos"])
        held = own.where(F.col("text") == F.col("base")).select("query_id", "pos", F.col("n").alias("held"))
        if made is not None:
            own = own.where(~F.col("made"))
        rival = own.where((F.col("text") != F.col("base")) & (F.col("n") >= change)).join(held, ["query_id", "pos"], "left").where(F.col("n") > F.coalesce("held", F.lit(0)))
        best, _ = written(rival.groupBy("query_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "pos", "text")).alias("b")).select("query_id", "b.pos", "b.text"), "best")
        if best.isEmpty():
            break
        rounds += 1
        if rounds > most_rounds:
            raise RuntimeError(f"changes still left after {most_rounds} rounds")
        made = best if made is None else written(made.unionByName(best), "made")[0]
        against = votes.join(best.withColumnRenamed("text", "new"), ["query_id", "pos"]).where(F.col("text") != F.col("new")).select("m").distinct()
        old = path
        votes, path = written(votes.join(against, "m", "left_anti"), "votes")
        drop_table(spark, old)
        drop_table(spark, counts_path)
    sure = counts.join(now, ["query_id", "pos"]).where((F.col("text") == F.col("base")) & (F.col("n") >= confirm)).groupBy("query_id").agg(F.collect_list("pos").alias("confirmed"))
    changed = (made if made is not None else best).groupBy("query_id").agg(F.collect_list(F.struct("pos", "text")).alias("changes"))  # at most one entry a base
    return sequences.select("query_id").join(changed, "query_id", "left").join(sure, "query_id", "left")


def repair(sequences: DataFrame, matches: DataFrame, confirm: int = 3, change: int = 3, overlap: float = 0.9, most_changed: float | None = None, most_matches: int = 2000) -> DataFrame:
    """(query_id, seq, qual, n_changes, n_confirmed, aborted) of every sequence; query_id is unique.

    sequences: query_id, seq, qual; matches: query_id, start, stop (on the query, 0-based, half-open), length (of the other sequence), qs, ss (aligned texts). Matches that cover less than
    `overlap` of what they could (the shorter sequence) are ignored. Sequences of which more than the share most_changed would change are returned as they were, aborted.
    A sequence with up to most_matches matches is repaired with them in one row; those with more by deep_changes, to the same result.
    """
    schema = "query_id string, seq string, qual array<int>, n_changes bigint, n_confirmed bigint, aborted boolean"

    def kept(query: str, seq: str, old: list[int] | None, result: tuple) -> tuple:
        s, q, n, c = result
        bad = most_changed is not None and n > most_changed * max(len(seq), 1)
        return (query, seq, old or [], 0, 0, True) if bad else (query, s, q, n, c, False)

    def shallow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query, text, old, found in zip(batch["query_id"], batch["seq"], batch["qual"], batch["found"], strict=True):
                seq, old = text or "", list(old) if old is not None else None
                m = [(int(x["start"]), x["qs"], x["ss"]) for x in (found if found is not None else ())]
                out.append(kept(query, seq, old, repair_one(seq, old, m, confirm, change)))
            yield pd.DataFrame(out, columns=["query_id", "seq", "qual", "n_changes", "n_confirmed", "aborted"])

    def deep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query, text, old, changes, sure in zip(batch["query_id"], batch["seq"], batch["qual"], batch["changes"], batch["confirmed"], strict=True):
                seq, old = text or "", list(old) if old is not None else None
                new = {int(x["pos"]): x["text"] for x in changes} if changes is not None else {}
                out.append(kept(query, seq, old, repaired(seq, old, new, set(map(int, sure)) if sure is not None else set())))
            yield pd.DataFrame(out, columns=["query_id", "seq", "qual", "n_changes", "n_confirmed", "aborted"])

    a = sequences.where("query_id is not null").select("query_id", "seq", "qual")
    usable = matches.where("query_id is not null and qs is not null and ss is not null").join(a.select("query_id", F.length(F.coalesce("seq", F.lit(""))).alias("__n")), "query_id").where(F.col("stop") - F.col("start") >= overlap * F.least("__n", "length"))
    usable, _ = written(usable.select("query_id", "start", "qs", "ss"), "usable")
    many, _ = written(usable.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > most_matches).select("query_id"), "many")
    found = usable.join(many, "query_id", "left_anti").groupBy("query_id").agg(F.collect_list(F.struct("start", "qs", "ss")).alias("found"))  # most_matches at most
    out = a.join(many, "query_id", "left_anti").join(found, "query_id", "left").select("query_id", "seq", "qual", "found").mapInPandas(shallow, schema)
    if many.isEmpty():
        return out
    hot = a.join(many, "query_id", "left_semi")
    changes = deep_changes(hot, usable.join(many, "query_id", "left_semi"), confirm, change)
    return out.unionByName(hot.join(changes, "query_id", "left").select("query_id", "seq", "qual", "changes", "confirmed").mapInPandas(deep, schema))


def repair_from_text(sequences: DataFrame, path: str, form: str = "blast", **options) -> DataFrame:
    """repair() with the matches of pairwise alignment text (form 'blast') or compact match text (form 'match'), whose positions count from 1."""
    from readloom.sources.files import register

    register(sequences.sparkSession)
    found = sequences.sparkSession.read.format(f"readloom_{form}").load(path)
    return repair(sequences, found.select("query_id", (F.col("start") - 1).alias("start"), "stop", "length", "qs", "ss"), **options)
