"""Both ways of masking, with keys in the tasks and by a join, against the rule read base by base."""

import random
from collections import Counter

import pytest

from readloom.operators import mask as M

TURN = str.maketrans("ACGT", "TGCA")


def plain_mask(seq, counts, k, least, below, coverage):
    """The rule, run by run."""
    u, x, out = seq.upper(), min(coverage, k), [False] * len(seq)
    canon = lambda w: min(w, w[::-1].translate(TURN))
    i = 0
    while i < len(u):
        if u[i] not in "ACGT":
            i += 1
            continue
        j = i
        while j < len(u) and u[j] in "ACGT":
            j += 1
        if j - i >= k:
            last = j - k
            hit = {p: least <= counts[canon(u[p : p + k])] < (below or 1 << 60) for p in range(i, last + 1)}
            state = {}
            for p in range(i, j):
                c = sum(hit[q] for q in range(max(i, p - k + 1), min(p, last) + 1))
                slots = min(p, last) - (max(i, p - k + 1) if p <= last else p - k + 1) + 1
                state[p] = 1 if c >= x else 0 if c < slots else None
            for p in range(i, j):
                left = next((state[q] for q in range(p - 1, i - 1, -1) if state[q] is not None), None)
                right = next((state[q] for q in range(p + 1, j) if state[q] is not None), None)
                out[p] = bool(state[p] if state[p] is not None else 1 if left == 1 else right or 0)
        i = j
    return out


@pytest.mark.parametrize(("k", "coverage", "below"), [(3, 1, None), (3, 2, 60), (4, 4, None), (5, 9, None)])
def test_masks(spark, k, coverage, below):
    rnd = random.Random(k)
    seqs = ["".join(rnd.choice("ACGTACacgtN") for _ in range(rnd.randrange(0, 40))) for _ in range(120)] + ["", "A" * 30, "ACGT" * 8, "N"]
    counts = Counter()
    for s in seqs:
        for p in range(len(s) - k + 1):
            w = s[p : p + k].upper()
            if set(w) <= set("ACGT"):
                counts[min(w, w[::-1].translate(TURN))] += 1
    df = spark.createDataFrame([(f"r{i}", s, [1], 5) for i, s in enumerate(seqs)], "name string, seq string, hits array<int>, kmer int")
    want = {(f"r{i}", p) for i, s in enumerate(seqs) for p, on in enumerate(plain_mask(s, counts, k, 4, below, coverage)) if on}
    for most_keys in (1000, 0):
        masked = M.masked_reads(df, k, 4, below, coverage, most_keys=most_keys)
        assert {(r.name, r.pos) for r in M.masked_positions(masked).collect()} == want and want
        assert masked.count() == len(seqs) and set(df.columns) < set(masked.columns)
