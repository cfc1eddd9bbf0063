"""Alignments of matched pairs for repair."""

import random

import pandas as pd

from readloom.operators import overlap as O
from readloom.plans import perread


def best_score(q: str, s: str) -> int:
    h = [[0] * (len(s) + 1) for _ in range(len(q) + 1)]
    for i, c in enumerate(q, 1):
        for j, e in enumerate(s, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (O.MATCH if c == e and c in "ACGT" else O.MISMATCH), h[i - 1][j] + O.GAP, h[i][j - 1] + O.GAP)
    return max(map(max, h))


def changed(rnd, t: str, share: float) -> str:
    return "".join(rnd.choice(["", c + rnd.choice("ACGT"), rnd.choice("ACGTN")]) if rnd.random() < share else c for c in t)


def test_align_against_plain_matrix():
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ACGT") for _ in range(rnd.randrange(35, 110))) for _ in range(40)]
    pairs = [(t, changed(rnd, t, 0.06)[rnd.randrange(12) :]) for t in texts] + [("ACGT", "ACGT"), ("", "A")]
    found = O.align(pairs)
    assert sum(f is not None for f in found) >= 38 and found[-2:] == [None, None]
    for (q, s), f in zip(pairs, found, strict=True):
        if f:
            score, a, b, c, d, x, y = f
            assert score == best_score(q, s) and x.replace("-", "") == q[a:b] and y.replace("-", "") == s[c:d] and len(x) == len(y)


def test_both_sides_and_strands(spark):
    rnd = random.Random(9)
    t = "".join(rnd.choice("ACGT") for _ in range(120))
    less = t[:60] + t[61:]
    rows = [("a", t, "b", less), ("c", t, "d", O._reverse(less)), ("e", t[:90], "f", t[30:]), ("g", t, "h", "".join(rnd.choice("ACGT") for _ in range(120)))]
    got = {r.query_id: r for r in O.aligned_pairs(spark.createDataFrame(rows, "a string, a_seq string, b string, b_seq string")).collect()}
    assert set(got) == set("abcdef")
    texts = {k: s for a, x, b, y in rows for k, s in ((a, x), (b, y))}
    assert all(r.qs.replace("-", "") == texts[k][r.start : r.stop] for k, r in got.items())
    assert got["d"].ss.replace("-", "") == O._reverse(t) and got["d"].qs.count("-") == 1
    assert (got["e"].start, got["e"].stop, got["e"].length) == (30, 90, 60) and (got["f"].start, got["f"].stop, got["f"].length) == (0, 60, 60)


def test_query_repairs_lost_base_of_read2(spark, tmp_path):
    rnd = random.Random(10)
    t = "".join(rnd.choice("ACGT") for _ in range(150))
    seqs = {"bad": t[:70] + t[71:], "m1": t, "m2": t, "m3": O._reverse(t)}
    pd.DataFrame([(i, "f.fasta", i, n, None, s, [30] * len(s)) for i, (n, s) in enumerate(seqs.items())], columns=["read_id", "file", "read_idx", "name", "comment", "seq", "qual"]).to_parquet(tmp_path / "raw_read.parquet")
    pd.DataFrame([("m1", "bad"), ("m2", "bad"), ("m3", "bad")], columns=["read1", "read2"]).to_parquet(tmp_path / "pair_match.parquet")
    got = {r.query_id: r for r in perread.QUERIES["i1_repaired_reads"](spark, str(tmp_path)).collect()}
    assert got["bad"].seq == t and got["bad"].n_changes == 1
