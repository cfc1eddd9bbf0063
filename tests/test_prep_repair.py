"""Per-read logic: hand-made cases and plain models."""

import random
import re

from readloom.operators import prep as P
from readloom.operators import repair as X
from readloom.operators.align import _pair_gap
from readloom.operators.route import pack_files


def test_repeat_tail():
    assert P.repeat_tail("ACGTACGTAAAAAAAA", 0, 16, 3) == 8
    assert P.repeat_tail("ACGTACGTACGT", 0, 12, 3) == 12
    assert P.repeat_tail("", 0, 0, 3) == 0
    rnd = random.Random(1)
    for _ in range(300):
        s = "".join(rnd.choice("AACGT") for _ in range(rnd.randrange(1, 30)))
        tails = [i for i in range(1, len(s)) if (len(s) - i) >= 2 * len(re.findall(r"(.)\1*", s[i:]))]
        want = len(s)
        if tails:
            want = tails[0] + re.search(r"(.)\1", s[tails[0] :]).start()
        assert P.repeat_tail(s, 0, len(s), 2) == want


def test_strict_window():
    q = [5] * 30 + [40] * 50 + [5] * 30
    a, b = P.strict_window(q, [(0, len(q))], 25)
    assert (a, b) == (30, 80)
    assert P.strict_window([5] * 50, [(0, 50)], 25) == (0, 0)
    assert P.strict_window([], [(0, 0)], 25) == (0, 0)
    assert P.strict_window([40] * 60, [(0, 60)], 25, "A" * 60, 0.8) == (0, 0)
    assert P.strict_window([40] * 60, [(0, 60)], 25, "ACGT" * 15, 0.8, min_clip=10) == (10, 60)
    assert P.strict_window([40] * 10 + [0] * 40 + [30] * 60, [(0, 20), (20, 110)], 25) == (50, 110)


def test_linker_clip():
    linker = "AGATCGGAAGAGCACACGTCTGAACTCCAG"
    kmers = frozenset(linker[i : i + 10] for i in range(len(linker) - 9))
    rnd = random.Random(2)
    body = "".join(rnd.choice("CT") for _ in range(120))
    assert P.clip_linker(body + linker + body, 0, 270, kmers, 10, 50) == (0, 120)
    assert P.clip_linker(linker + body, 0, 150, kmers, 10, 50) == (0, 0)
    assert P.clip_linker(body, 5, 110, kmers, 10, 50) == (5, 110)
    assert P.clip_linker(body, 5, 40, kmers, 10, 50) == (0, 0)
    assert P.clip_linker("", 0, 0, kmers, 10, 50) == (0, 0)
    assert P.clip_linker(body + linker[:14] + "NNN" + linker[17:] + body, 0, 270, kmers, 10, 50) == (0, 120)


def test_poly_trim():
    body = "ACGTC" * 20
    assert P.trim_poly("A" * 12 + body, 0, 112) == (13, 112)
    assert P.trim_poly(body + "GTTTTTTTTTTT", 0, 112) == (0, 101)
    assert P.trim_poly(body, 0, 100) == (0, 100)
    assert P.trim_poly("A" * 60, 0, 60) == (0, 0)
    assert P.trim_poly("", 0, 0) == (0, 0)
    assert P.trim_poly("ACGTCAC" + body, 0, 107, frozenset(["ACGTCAC"])) == (7, 107)


def test_simple_score():
    rnd = random.Random(3)
    assert P.simple_score("AC" * 60, 0, 120) > 0.96
    assert P.simple_score("".join(rnd.choice("ACGT") for _ in range(300)), 0, 300) < 0.5
    assert P.simple_score("NNNN", 0, 4) == 1.0 == P.simple_score("", 0, 0)


def test_targets():
    q = [40] * 1000 + [1] * 10 + [40] * 1000
    s = "A" * 1000 + "N" * 10 + "A" * 1000
    assert P.low_quality_targets(s, q) == [(1000, 1010)]
    q2 = [10] * 5 + q[5:1500] + [10] * 5 + q[1505:]
    assert P.low_quality_targets(s, q2) == [(0, 5), (1000, 1010), (1500, 1505)] or P.low_quality_targets(s, q2) == [(0, 5), (1000, 1505)]
    assert P.low_quality_targets("", []) == []
    assert P.low_quality_targets("N" * 5, [1] * 5) == [(0, 5)]


def test_mended_qualities():
    assert P.mend_qualities("40 4038 38 0 98 99") == [40, 40, 38, 38, 0, 98, 99]
    assert P.mend_qualities("") == []
    assert P.mend_qualities("40 012") == [40, 0, 12]


def test_prepare(spark):
    rnd = random.Random(5)
    good = "".join(rnd.choice("ACGT") for _ in range(150))
    rows = [("a", good, [40] * 150), ("b", "N" * 30, [40] * 30), ("c", good, [2] * 150), ("d", "AC" * 75, [40] * 150), ("e", None, None), ("f", "", []), ("g", "NN" + good.lower(), [0, 0] + [40] * 150)]
    df = spark.createDataFrame(rows, "name string, seq string, qual array<int>").withColumnRenamed("name", "name")
    got = {r.name: r for r in P.prepare(df, frozenset(), 10).collect()}
    assert {n: r.status for n, r in got.items()} == {"a": "kept", "b": "n", "c": "quality", "d": "simple", "e": "n", "f": "n", "g": "kept"}
    assert got["g"].seq == good and got["a"].qual == [40] * 150


def test_repair(spark):
    rnd = random.Random(6)
    true = "".join(rnd.choice("ACGT") for _ in range(200))
    bad = true[:60] + ("A" if true[60] != "A" else "C") + true[61:]
    m = [("q", 0, 200, 200, bad, true)] * 4 + [("q", 0, 50, 200, bad[:50], "A" * 50), (None, 0, 1, 1, "A", "A")]
    seqs = spark.createDataFrame([("q", bad, [20] * 200), ("alone", "ACGT", None), ("null", None, None), (None, "A", [1])], "query_id string, seq string, qual array<int>")
    matches = spark.createDataFrame(m, "query_id string, start int, stop int, length int, qs string, ss string")
    got = {r.query_id: r for r in X.repair(seqs, matches).collect()}
    assert got["q"].seq == true and got["q"].n_changes == 1 and got["q"].qual.count(40) > 180
    assert got["alone"].seq == "ACGT" and got["null"].seq == "" and set(got) == {"q", "alone", "null"}
    assert X.repair(seqs, matches, most_changed=0.001).where("query_id = 'q'").first().aborted
    gap = true[:80] + true[81:]
    s, q, n, _ = X.repair_one(gap, None, [(0, true[:80] + "-" + true[81:], true)] * 3, 3, 3)
    assert s == true and n == 1 and len(q) == 200


def test_repair_withdraws_contradicting_matches():
    seq = "ACGTCAGTACGATCAGTACTGACTGATCGA"
    at = lambda *changes: "".join(dict(changes).get(i, c) for i, c in enumerate(seq))
    one, two = at((8, "G")), at((20, "A"))  # two variants: each has one of the changes and the query's base at the other place
    s, _, n, _ = X.repair_one(seq, None, [(0, seq, one)] * 4 + [(0, seq, two)] * 3, 2, 3)
    assert s == one and n == 1
    linked = [(0, seq, one)] * 4 + [(0, seq, two)] * 3 + [(12, seq[12:], two[12:])] * 2
    s, _, n, confirmed = X.repair_one(seq, None, linked, 5, 3)  # the five votes for A at 20 go first; the four for G are withdrawn with their base there
    assert s == two and n == 1 and confirmed == 16


def test_deep_repair_is_the_same(spark):
    """Sequences with more matches than a row may hold, over all tasks: what repair_one makes of them."""
    rnd = random.Random(7)
    seqs, matches = [], []
    for i in range(12):
        true = "".join(rnd.choice("ACGT") for _ in range(60))
        other = list(true)
        for p in rnd.sample(range(60), 4):
            other[p] = rnd.choice("ACGT")
        bad = "".join(c if rnd.random() > 0.05 else rnd.choice("ACGTacgtN") for c in true)
        seqs.append((f"q{i}", bad, [20] * 60 if i % 3 else None))
        for _ in range(rnd.randrange(0, 25)):
            a, z = rnd.randrange(0, 4), rnd.randrange(56, 61)
            text = "".join(rnd.choice([true, true, "".join(other)])[p] if rnd.random() > 0.02 else rnd.choice("ACGTN-") for p in range(a, z))
            matches.append((f"q{i}", a, z, 60, bad[a:z], text))
    s = spark.createDataFrame(seqs, "query_id string, seq string, qual array<int>")
    m = spark.createDataFrame(matches, "query_id string, start int, stop int, length int, qs string, ss string")
    rows = [sorted(map(repr, X.repair(s, m, 2, 2, most_changed=0.08, most_matches=n).collect())) for n in (1000, 5, 0)]
    assert rows[0] == rows[1] == rows[2] and "n_changes=2" in str(rows[0])


def test_repair_from_text(spark, tmp_path):
    rnd = random.Random(11)
    true = "".join(rnd.choice("ACGT") for _ in range(60))
    bad = true[:30] + ("A" if true[30] != "A" else "C") + true[31:]
    blast = "Query= q some\n\n" + "".join(
        f">t{i} x\n          Length = 60\n\n Score = 90 bits (1)\n Identities = 59/60 (98%)\n Strand = Plus / Plus\n\nQuery: 1 {bad} 60\n\nSbjct: 1 {true} 60\n\n\n" for i in range(4)
    )
    (tmp_path / "m.blast").write_text(blast)
    (tmp_path / "m.match").write_text("=q\n" + "".join(f">t{i} 60\n59 90 1 60 1 60\n{bad} {true}\n" for i in range(4)))
    s = spark.createDataFrame([("q", bad, [20] * 60)], "query_id string, seq string, qual array<int>")
    for form in ("blast", "match"):
        r = X.repair_from_text(s, str(tmp_path / f"m.{form}"), form).first()
        assert r.seq == true and r.n_changes == 1


def test_pair_gap():
    assert _pair_gap([40, 40], [0, 88], [0, 88], 40, 40) == 0
    assert _pair_gap([40], [0], [0], 40, 40) == -1
    assert _pair_gap([30, 40], [0, 95], [0, 95], 40, 40) == 10


def test_pack_files():
    bins = pack_files({f"f{i}": i for i in range(1, 20)}, 4)
    assert sorted(sum(bins, [])) == sorted(f"f{i}" for i in range(1, 20)) and len(bins) == 4
