"""Postings: every k-mer of every read."""

from collections import Counter

import pandas as pd

from readloom.plans import kmers


def test_all_postings_against_brute_force(spark, tmp_path):
    seqs = {1: "ACGTACGTACGTACGTTT", 2: "A" * 16, 3: "ACGTNACGTACGTACGTACGA", 4: "ACG"}
    pd.DataFrame([(i, "f.fasta", i, f"r{i}", None, s, [30] * len(s)) for i, s in seqs.items()], columns=["read_id", "file", "read_idx", "name", "comment", "seq", "qual"]).to_parquet(tmp_path / "raw_read.parquet")
    want = Counter()
    for i, s in seqs.items():
        for w in (s[p : p + 14] for p in range(len(s) - 13)):
            if set(w) <= set("ACGT"):
                want[min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))), i] += 1
    assert 1 in want.values() and max(want.values()) > 1
    assert {(r.kmer, r.read_id): r.n for r in kmers.QUERIES["a30_postings_all"](spark, str(tmp_path)).collect()} == want
