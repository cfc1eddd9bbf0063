import random

import pytest

from readloom.llm.shared_spans import shared_amounts, shared_spans

SCHEMA = "read_id bigint, name string, seq string, pos int"


def reads_of(spark, seqs):
    return spark.createDataFrame([(i + 1, f"n{i + 1}", s, 7) for i, s in enumerate(seqs)], SCHEMA)


@pytest.mark.parametrize("length", [1, 0, -5])
def test_lengths_under_two_raise(spark, length):
    with pytest.raises(ValueError, match="under 2"):
        shared_spans(reads_of(spark, ["ACGT" * 40]), length)


def want(seqs, length):
    own = {}
    for i, s in enumerate(seqs):
        for p in range(len(s or "") - length + 1):
            w = s[p : p + length].upper()
            if set(w) <= set("ACGT"):
                own.setdefault(w, {}).setdefault(i, []).append(p)
    covered = [[False] * len(s or "") for s in seqs]
    for at in own.values():
        if len(at) > 1:
            for i, ps in at.items():
                for p in ps:
                    covered[i][p : p + length] = [True] * length
    out = set()
    for i, c in enumerate(covered):
        p = 0
        while p < len(c):
            e = p
            while e < len(c) and c[e]:
                e += 1
            if e > p:
                out.add((i + 1, p, e))
            p = max(e, p + 1)
    return out


@pytest.fixture(scope="module")
def long_reads():
    rnd = random.Random(12)
    dna = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    parts = [dna(n) for n in (100, 129, 200, 257, 300, 700)]
    seqs = [None, "", "ACG", "A" * 400, "A" * 350 + "C"]
    for p in parts:
        seqs += [dna(30) + p + dna(rnd.randrange(60)), p + dna(50), dna(10) + p[: len(p) // 2] + "N" + p[len(p) // 2 :]]
        q = list(p)
        q[len(p) // 2] = "A" if q[len(p) // 2] != "A" else "C"  # the ends are the same, the middle is not
        seqs.append("".join(q))
    seqs += [parts[2].lower(), parts[2], parts[5] * 2, "AC" * 300]
    return seqs


@pytest.mark.parametrize("length", [20, 64, 65, 100, 128, 300])
def test_spans_of_any_length(spark, long_reads, length):
    got = {(r.read_id, r.span_start, r.span_stop) for r in shared_spans(reads_of(spark, long_reads), length).collect()}
    assert got == want(long_reads, length) and got


def test_no_candidates_survive(spark, long_reads):
    assert shared_spans(reads_of(spark, long_reads), 5000).count() == 0
    assert shared_spans(reads_of(spark, [s[:90] if s else s for s in long_reads]).limit(0), 100).count() == 0


def test_shared_amounts(spark, long_reads):
    got = {r.read_id: (r.read_length, r.shared_bases) for r in shared_amounts(reads_of(spark, long_reads), 100).collect()}
    shared = {}
    for i, a, b in want(long_reads, 100):
        shared[i] = shared.get(i, 0) + b - a
    assert got == {i + 1: (len(s), shared.get(i + 1, 0)) for i, s in enumerate(long_reads) if s}
