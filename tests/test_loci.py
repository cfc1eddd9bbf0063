"""Loci of any length against plain text search."""

import random

import pytest

from readloom.operators import search as S

TURN = str.maketrans("ACGT", "TGCA")


@pytest.mark.parametrize("at_once", [500_000, 7])
def test_loci_of_any_length(spark, monkeypatch, at_once):
    monkeypatch.setattr(S, "LOCI_AT_ONCE", at_once)
    rnd = random.Random(3)
    dna = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    loci = [dna(n) for n in (3, 5, 12, 31, 32, 33, 40, 64, 65, 150)] + ["ACGT", "GAATTC", dna(40)]
    loci.append(loci[6][:32] + dna(8))  # the first 32 bases alike
    reads = [dna(20) + x + dna(rnd.randrange(9)) + x[::-1].translate(TURN) for x in loci]
    reads += [x.lower() for x in loci] + [loci[7][:40] + "N" + loci[7][41:], loci[9][:149], "", None, "NNNN", dna(3000)]
    df = spark.createDataFrame([(f"r{i}", s, 7) for i, s in enumerate(reads)], "name string, seq string, pos int")
    table = spark.createDataFrame([("p", x.lower() if i % 3 else x) for i, x in enumerate(loci + loci[:4])] + [("p", None), ("p", ""), ("p", "NONE"), ("p", "ACNGT")], "parent string, seq string")
    got = sorted((r.name, r.pos, r.strand, r.locus_seq) for r in S.find_loci(df, table, ["name"]).collect())
    want = []
    for i, s in enumerate(reads):
        for x in loci:
            for strand, text in (("+", x), ("-", x[::-1].translate(TURN))):
                if strand == "-" and text == x:
                    continue
                p = (s or "").upper().find(text)
                while p >= 0:
                    want.append((f"r{i}", p, strand, x))
                    p = (s or "").upper().find(text, p + 1)
    assert got == sorted(want) and len({w[3] for w in want}) == len(set(loci))
    assert S.find_loci(df, table.limit(0), ["name"]).count() == 0
