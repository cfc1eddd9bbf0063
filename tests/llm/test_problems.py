"""The problems' operators against brute force on small inputs, with nulls, empties, ties, repeats and extra columns."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from readloom.session import build  # noqa: F401

TR = str.maketrans("ACGT", "TGCA")
READ = "read_id bigint, name string, seq string, loaded_at bigint, file string, read_idx bigint, weight int, term string, rep int"


def rc(s):
    return s[::-1].translate(TR)


def words(s, k, canonical=True):
    out, s = [], (s or "").upper()
    for i in range(len(s) - k + 1):
        w = s[i : i + k]
        if set(w) <= set("ACGT"):
            out.append(min(w, rc(w)) if canonical else w)
    return out


@pytest.fixture(scope="module")
def reads():
    rnd = random.Random(3)
    dna = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    base = [dna(rnd.randrange(60, 200)) for _ in range(60)]
    seqs = [None, "", "A", "ACGT" * 2, "N" * 50, "A" * 150, "A" * 90 + "T" * 60, base[0], base[0].lower(), rc(base[0])]
    adapter = dna(40)
    for b in base:
        seqs.append(b)
        for _ in range(rnd.randrange(0, 4)):
            c = list(b)
            for _ in range(rnd.randrange(0, 5)):
                p = rnd.randrange(len(c))
                c[p] = rnd.choice(["A", "C", "G", "T", "N", "", c[p] + "G"])
            seqs.append(rnd.choice([str, str.lower, rc])("".join(c)) if "N" not in c else "".join(c))
        seqs.append(dna(70) + adapter + dna(30))
    seqs += [base[1]] * 40 + [base[2][:100] + dna(40)]
    rows = [(i + 1, f"n{i + 1}", s, 5, "f", i, 9, "x", 1) for i, s in enumerate(seqs)]
    return rows + [(r[0], r[1], r[2], 6, "g", 10_000 + r[5], 9, "y", 2) for r in rows[::7]] + [(None, "none", base[3], 1, "f", 77, 1, "z", 1)]


def table(spark, rows, schema=READ):
    return spark.createDataFrame(rows, schema)


def one(rows):
    return {r[0]: r for r in reversed(rows) if r[0] is not None}


def test_near_duplicates(spark, reads):
    from readloom.llm.near_duplicates import expand_pairs, similar_pairs

    got = {tuple(r) for r in expand_pairs(*similar_pairs(table(spark, reads), 12, 0.6)).collect()}
    low = {}
    for i, r in one(reads).items():
        if r[2]:
            low[r[2].upper()] = min(low.get(r[2].upper(), i), i)
    # the row without id still names a sequence that another read has
    sets = {i: set(words(s, 12)) for s, i in low.items()}
    ids = sorted(i for i in sets if sets[i])
    want = {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9}
    assert got == want and len(want) > 30


def test_least_agreement_keeps_similar_pairs():
    from readloom.llm.near_duplicates import least_agreement

    for n in (32, 64, 128):
        m = least_agreement(n, 0.6, 1e-6, 0.25)
        p = 0.6 + 0.4 / 4
        assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(m)) < 1e-4


@pytest.mark.parametrize("length", [64, 40, 33, 20])
def test_shared_spans(spark, reads, length):
    from readloom.llm.shared_spans import shared_spans

    got = {(r.read_id, r.span_start, r.span_stop) for r in shared_spans(table(spark, reads), length).collect()}
    r1 = one(reads)
    own = defaultdict(set)
    for i, r in r1.items():
        for w in words(r[2], length, False):
            own[w].add(i)
    want = set()
    for i, r in r1.items():
        s = (r[2] or "").upper()
        at = [any(len(own.get(s[q : q + length], ())) > 1 for q in range(max(0, p - length + 1), min(p, len(s) - length) + 1)) for p in range(len(s))]
        p = 0
        while p < len(s):
            if at[p]:
                e = p
                while e < len(s) and at[e]:
                    e += 1
                want.add((i, p, e))
                p = e
            p += 1
    assert got == want and want


def test_frequent_values(spark):
    from readloom.llm.heavy_hitters import frequent_values

    rnd = random.Random(1)
    vals = [f"v{int(rnd.paretovariate(0.7))}" for _ in range(6000)] + [None, ""] * 500
    df = spark.createDataFrame([(v, 1, "h") for v in vals], "seq string, n int, h string")
    got = {r.value: r.n_rows for r in frequent_values(df, "seq", 40).collect()}
    assert got == {v: n for v, n in Counter(x for x in vals if x).items() if n >= 40}
    assert frequent_values(df.limit(0), "seq", 1).count() == 0


def test_frequent_values_with_many_answers(spark):
    """Thousands of answers, a width far too small for them, and an end by plain counting: nothing is lost."""
    from readloom.llm.heavy_hitters import frequent_values

    df = spark.range(200_000).select(F.concat(F.lit("v"), F.when(F.col("id") % 10 < 9, F.col("id") % 3_600).otherwise(F.col("id"))).alias("seq"))
    want = {r.seq: r["count"] for r in df.groupBy("seq").count().where("count >= 50").collect()}
    got = {r.value: (r.n_rows, r.n_estimated) for r in frequent_values(df, "seq", 50).collect()}
    assert {v: n for v, (n, _) in got.items()} == want and len(want) > 3_000 and all(e >= n for n, e in got.values())
    few = df.where("hash(seq) % 20 = 0")
    want = {r.seq: r["count"] for r in few.groupBy("seq").count().where("count >= 50").collect()}
    for rounds in (0, 1, 6):
        got = {r.value: r.n_rows for r in frequent_values(few, "seq", 50, width=64, most_rounds=rounds).collect()}
        assert got == want and len(want) > 50


@pytest.mark.parametrize("k", [32, 8])
def test_base_word_counts(spark, reads, k):
    from readloom.functions.reads import one_per_read
    from readloom.llm.term_counts import base_word_counts

    got = {r.term: (r.occurrences, r.records, r.mark) for r in base_word_counts(one_per_read(table(spark, reads), keep=("seq",)), k, 2, 30).collect()}
    occ, rec = Counter(), Counter()
    for r in one(reads).values():
        occ.update(words(r[2], k))
        rec.update(set(words(r[2], k)))
    assert got == {w: (occ[w], rec[w], "rare" if rec[w] < 2 else "common" if rec[w] >= 30 else "kept") for w in occ}


def test_term_counts(spark):
    from readloom.llm.term_counts import term_counts

    rows = [(1, "a b a"), (1, "a c"), (2, None), (3, ""), (4, "b b"), (None, "a")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.term: (r.occurrences, r.records) for r in term_counts(df, "id", F.filter(F.split("text", " "), lambda x: x != ""), 1, 9).collect()}
    assert got == {"a": (3, 1), "b": (3, 2), "c": (1, 1)}


def test_term_counts_over_many_parts(spark):
    """Terms in every record, records in many rows and partitions, and batches much smaller than a term."""
    from readloom.llm.term_counts import term_counts

    rnd = random.Random(5)
    rows = [(rnd.randrange(400), " ".join(rnd.choice(["the", "of", "a", f"w{rnd.randrange(300)}"]) for _ in range(12)), "x") for _ in range(3000)]
    want_n, want_r = Counter(), defaultdict(set)
    for i, text, _ in rows:
        for w in text.split():
            want_n[w] += 1
            want_r[w].add(i)
    df = spark.createDataFrame(rows, "id int, text string, term string").repartition(13)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {r.term: (r.occurrences, r.records, r.mark) for r in term_counts(df, "id", F.split("text", " "), 20, 300).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {w: (n, len(want_r[w]), "rare" if len(want_r[w]) < 20 else "common" if len(want_r[w]) >= 300 else "kept") for w, n in want_n.items()}
    assert term_counts(df.limit(0), "id", F.split("text", " "), 1, 2).count() == 0


def test_connected_groups(spark):
    from readloom.llm.groups import connected_groups

    rnd = random.Random(2)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, 2000 + i) for i in range(1, 300)]
    links += [(5, 5), (None, 7), (8, None)] + links[:50]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(a, b, 1) for a, b in links], "a bigint, b bigint, label int")
    got = {r.id: r.group_id for r in connected_groups(df).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_groups(df.limit(0)).count() == 0
    assert {r.id: r.group_id for r in connected_groups(df, rate=0.5, stride=5, seed=9).collect()} == got


def test_top_n(spark):
    from readloom.llm.top_n import top_n

    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 1, 2, 3, 4, None]), i // 2 if i % 5 else i, rnd.choice([None, 1, 2, 3]), 0) for i in range(4000)]
    rows += rows[:500]
    df = spark.createDataFrame(rows, "g bigint, i bigint, score int, k0 int")
    for n in (1, 3, 50):
        got = {(r.g, r.rank_no): r.i for r in top_n(df.repartition(7), "g", "i", [F.col("score").isNull(), -F.coalesce("score", F.lit(0))], n).collect()}
        best: dict = {}
        for g, i, s, _ in rows:
            if g is not None:
                key = (s is None, -(s or 0), i)
                best[g, i] = min(best.get((g, i), key), key)
        want = {}
        for g in (1, 2, 3, 4):
            for k, (_, _, i) in enumerate(sorted(v for (h, _), v in best.items() if h == g)[:n]):
                want[g, k + 1] = i
        assert got == want
    assert top_n(df.limit(0), "g", "i", [F.col("score")], 3).count() == 0


def test_packing(spark):
    from readloom.llm.packing import fill_report, pack, pack_items

    rnd = random.Random(6)
    sizes = [min(9000, int(rnd.lognormvariate(6, 1)) + 1) for _ in range(3000)]
    for cap in (512, 2048):
        bins = pack(sizes, cap)
        seen = Counter()
        for b in bins:
            assert 0 < sum(e - s for _, s, e in b) <= cap
            for i, s, e in b:
                seen[i] += e - s
                assert sizes[i] > cap or (s, e) == (0, sizes[i])
        assert seen == Counter(dict(enumerate(sizes)))
        lower = max(-(-sum(sizes) // cap), sum(n // cap + (n % cap > cap / 2) for n in sizes))
        assert len(bins) <= 1.01 * lower + 1
    items = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)] + [(None, 5, "x"), (9999, None, "x"), (9998, 0, "x")], "doc_id bigint, n_tokens bigint, shard string")
    kinds = spark.createDataFrame([("a", 700), ("b", 3000), ("c", None), ("d", 0)], "bin_kind string, capacity_tokens int")
    packed = pack_items(items, kinds, shard_size=500)
    rep = {r.bin_kind: r for r in fill_report(packed).collect()}
    assert set(rep) == {"a", "b"} and all(r.n_tokens == sum(sizes) and r.fill > 0.93 for r in rep.values())
    assert packed.groupBy("bin_kind", "doc_id", "part_no").count().where("count > 1").count() == 0
    assert pack_items(items.limit(0), kinds).count() == 0
    with pytest.raises(ValueError, match="1000 kinds"):
        pack_items(items, spark.range(2000).selectExpr("string(id) AS bin_kind", "int(id + 1) AS capacity_tokens"))


def test_temperature_weights():
    from readloom.llm.mixing import entropy, entropy_weights, temperature_weights, tempered_weights

    q = {"a": 0.7, "b": 0.2, "c": 0.1, "d": 0.0}
    for h in (0.3, 0.6, 1.0):
        w, _ = temperature_weights(q, h)
        assert abs(entropy(w) - h) < 1e-6 and w["a"] >= w["b"] >= w["c"] and w["d"] == 0
    # one source binds: it keeps its limit, the others share the rest as their targets do
    tokens, most = {"a": 1000, "b": 10, "c": 500, "d": 0}, {"a": 2, "b": 2, "c": 2, "d": 5}
    w, x = tempered_weights({"a": 0.3, "b": 0.4, "c": 0.2, "d": 0.1}, tokens, most, 1510)
    assert abs(w["b"] - 20 / 1510) < 1e-9 and 0 < x["b"] < 1 and x["a"] == x["c"] == 0 and w["d"] == 0
    assert abs(w["a"] / w["c"] - 1.5) < 1e-9 and abs(sum(w.values()) - 1) < 1e-9
    # everything fits: the targets themselves; nothing fits: every source at its limit
    assert tempered_weights({"a": 0.3, "b": 0.4, "c": 0.2}, tokens, most, 40)[0] == pytest.approx({"a": 3 / 9, "b": 4 / 9, "c": 2 / 9})
    w, x = tempered_weights({"a": 0.3, "b": 0.4, "c": 0.3}, tokens, most, 1e6)
    assert w == pytest.approx({"a": 2e-3, "b": 2e-5, "c": 1e-3}) and set(x.values()) == {1.0}
    assert tempered_weights({"a": 0.0}, tokens, most, 100)[0] == {"a": 0.0} and tempered_weights({}, {}, {}, 0) == ({}, {})
    w, x = entropy_weights(tokens, most, 1510, 1.0)
    assert w["b"] * 1510 <= 20 + 1e-6 and 0 < x["a"] < 1
    w, _ = entropy_weights(tokens, {s: 100 for s in tokens}, 1510, 1.0)
    assert abs(entropy(w) - 1.0) < 1e-6


@pytest.mark.parametrize("seed", range(20))
def test_tempered_weights_are_the_nearest(seed):
    """No tokens can be moved from a source above its target's part to one below it: those below are at their limits."""
    from readloom.llm.mixing import normalised, tempered_weights

    rnd = random.Random(seed)
    names = "abcdef"
    tokens, most = {s: rnd.randrange(1, 10_000) for s in names}, {s: rnd.randrange(1, 5) for s in names}
    t = normalised({s: rnd.random() for s in names})
    budget = sum(tokens.values())
    w, x = tempered_weights(t, tokens, most, budget)
    assert abs(sum(w.values()) - 1) < 1e-6
    for s in names:
        assert w[s] * budget <= most[s] * tokens[s] * (1 + 1e-9)
        assert w[s] >= t[s] - 1e-9 or abs(w[s] * budget - most[s] * tokens[s]) < 1e-3
    free = [s for s in names if x[s] == 0]
    assert all(abs(w[s] / t[s] - w[free[0]] / t[free[0]]) < 1e-9 for s in free)


def test_mixing(spark):
    from readloom.llm.mixing import mix_sources

    rnd = random.Random(8)
    docs = [(i, rnd.choice("aaaaaaab" + "c" * 3) if i % 50 else None, rnd.randrange(1, 400), 1) for i in range(5000)] + [(9001, "a", None, 1), (None, "b", 5, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint, block int")
    t = spark.createDataFrame([("r", "a", 0.3, 2), ("r", "b", 0.4, 5), ("r", "c", 0.2, 1), ("r", "gone", 0.1, 3), ("s", "a", 1.0, 3), ("s", "b", 0.0, 1)], "recipe string, source string, target_share double, max_repeats int")
    tokens = {s: sum(n for i, x, n, _ in docs if x == s and i is not None and n) for s in "abc"}
    chosen, report = mix_sources(df, t)
    rep = {(r.recipe, r.source): r for r in report.collect()}
    # b is small: it is used five times over, a and c share the rest as 3 to 2, up to what one pass of c holds
    assert rep["r", "b"].mean_repeats == 5 and 0 < rep["r", "b"].exponent < 1 and rep["r", "gone"].mixed_tokens == 0
    assert abs(sum(r.mixed_tokens for k, r in rep.items() if k[0] == "r") - sum(tokens.values())) < 1000
    assert abs(rep["r", "a"].reached_share / rep["r", "c"].reached_share - 1.5) < 0.01 or rep["r", "c"].mean_repeats == 1
    assert rep["s", "a"].reached_share == 1 and rep["s", "a"].mean_repeats == 1
    rows = chosen.collect()
    assert len({(r.recipe, r.doc_id) for r in rows}) == len(rows)
    most = {("r", "a"): 2, ("r", "b"): 5, ("r", "c"): 1, ("s", "a"): 3}
    assert all(1 <= r.repeats <= most[r.recipe, r.source] for r in rows)
    total = Counter()
    for r in rows:
        total[r.recipe, r.source] += r.repeats * r.n_tokens
    assert all(rep[k].mixed_tokens == v for k, v in total.items())
    chosen, report = mix_sources(df, t, budget=10_000_000)
    assert {r.source: r.exponent for r in report.where("recipe = 'r'").collect()} == {"a": 1.0, "b": 1.0, "c": 1.0, "gone": 0.0}
    chosen, report = mix_sources(df, t, budget=3000)
    rep = {(r.recipe, r.source): r for r in report.collect()}
    assert {r.exponent for r in rep.values()} == {0.0}
    for s, share in (("a", 3 / 9), ("b", 4 / 9), ("c", 2 / 9), ("gone", 0)):
        assert abs(rep["r", s].reached_share - share) < 0.08
    even = {(r.recipe, r.source): r for r in mix_sources(df, t.where("recipe = 'r'"), budget=3000, target_entropy=math.log(3) - 1e-9)[1].collect()}
    assert all(abs(even["r", s].reached_share - 1 / 3) < 0.08 for s in "abc")
    assert mix_sources(df.limit(0), t)[0].count() == 0


def test_prose():
    from readloom.llm.prose import Tokens, counts, running_prose, syllables

    text = "﻿\\documentclass{a}\r\n\\newcommand{\\x}{blue house}\n\\begin{document}\n\\section{No Title}\nThe \\emph{big} \\x{} is, e.g. here, $a+b$ red~\\cite{k}. % no\nIt ran in Lee et al.\n\\iffalse\nNo draft.\n\\fi\n\\begin{equation}x\\end{equation}\n\\undefd{} One more (see Fig.~3).\n\\end{document} no"
    w, s, y, items = counts(text, Tokens(1 << 16))
    assert " ".join(" ".join(running_prose(text)).split()).startswith("The big blue house is, e.g. here, red . It ran in Lee et al. One more")
    assert (w, s, len(items)) == (18, 3, 18) and y >= w  # pointers such as "see Fig. 3" are words like any other
    assert [syllables(x) for x in ("the", "table", "house", "electrodynamics", "rhythm")] == [1, 2, 1, 6, 1]
    for t in ("", " \n ", "%", "$", "\\begin{equation} x", "{{{", "\\", "x" * 200_000, "a. " * 50_000):
        counts(t, Tokens(1 << 16))


def test_reading_levels(spark):
    from readloom.llm.reading_level import ENGLISH, reading_levels

    rnd = random.Random(9)
    easy, hard = "cat dog sun big red run see the a boat".split(), "electrodynamics characterization multidimensional regularization parameter hypothesis the of environment".split()
    docs, want = [], {}
    for i in range(600):
        level = i % 4 + 1
        p, n = {1: (0.02, 7), 2: (0.14, 14), 3: (0.3, 17), 4: (0.5, 24)}[level]
        docs.append((i, " ".join(" ".join(rnd.choice(hard if rnd.random() < p else easy) for _ in range(n)) + "." for _ in range(400 // n)), ["en", "EN", "en-GB", "en_us"][i % 4 if i % 3 else 0], level))
        want[i] = level
    docs += [(1000, docs[0][1], None, 1), (1001, docs[0][1], "de", 1), (1002, "Short text.", "en", 1), (1003, None, "en", 1), (1004, "", "en", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, words int")
    # every third document has a label, one in ten of them wrong; nulls, values out of range and labels of other documents count nothing
    graded = [(i, "g", (want[i] if rnd.random() > 0.1 else rnd.randrange(1, 5)), 7) for i in range(0, 600, 3)] + [(1, "g", None, 7), (2, "g", 9, 7), (1002, "g", 4, 7), (None, "g", 1, 7), (77777, "g", 1, 7)]
    labels = spark.createDataFrame(graded, "doc_id bigint, grader string, reading_level int, latent int")
    got = {r.doc_id: r.reading_level for r in reading_levels(df, labels).collect()}
    assert set(got) == set(want) and ENGLISH
    held_out = [i for i in want if i % 3]
    assert sum(got[i] == want[i] for i in held_out) >= 0.95 * len(held_out)
    # without labels the link is its prior: still one level a document, rising with the true ones
    free = {r.doc_id: r.linked for r in reading_levels(df, labels.limit(0)).collect()}
    assert set(free) == set(want)
    mean = [sum(free[i] for i in want if want[i] == k) for k in (1, 2, 3, 4)]
    assert mean == sorted(mean)
    assert reading_levels(df.limit(0), labels).count() == 0


def test_ordered_link_finds_its_own_parameters():
    import numpy as np

    from readloom.llm.reading_level import ordered_link

    rng = np.random.default_rng(4)
    x = rng.normal(size=(40_000, 3))
    w, k = np.array([2.0, -1.0, 0.5]), np.array([-2.0, 0.0, 3.0])
    z = x @ w + rng.logistic(size=len(x))
    got_w, got_k = ordered_link(x, 1 + (z[:, None] > k).sum(axis=1))
    assert np.abs(got_w - w).max() < 0.1 and np.abs(got_k - k).max() < 0.1
    prior_w, prior_k = ordered_link(x[:0], np.zeros(0, int))
    assert list(prior_w) == [1, 1, 1] and list(prior_k) == [-2, 0, 2]


def test_difficulty_steps_recover_a_simulated_model():
    """Counts drawn from the model: the fitted difficulties follow the true ones."""
    import numpy as np

    from readloom.llm import reading_level as R

    rng = np.random.default_rng(1)
    n_items, n_docs = 60, 3000
    base, true = np.log(rng.dirichlet(np.ones(n_items) * 3)), rng.normal(size=n_items) * 0.4
    level = rng.normal(size=n_docs)
    p = np.exp(base + level[:, None] * true)
    counts = np.stack([rng.multinomial(300, q) for q in p / p.sum(axis=1, keepdims=True)])
    model, guess = R.Model(np.log(counts.sum(0) / counts.sum()), np.zeros(n_items)), level + rng.normal(size=n_docs)  # a noisy start
    for _ in range(15):
        guess = (guess - guess.mean()) / guess.std()
        model = model.moved(counts.sum(0).astype(float), counts.T @ guess, R._split(guess, np.full(n_docs, 300.0)), 5.0)
        guess = np.interp(counts @ model.difficulty / 300, model.mean, R.GRID)
    assert np.corrcoef(model.difficulty, true)[0, 1] > 0.98 and np.corrcoef(guess, level)[0, 1] > 0.9


def test_sizes(spark):
    from readloom.llm.tokens import encoding, with_sizes, VOCABULARY

    texts = ["A cat.", "", None, "x" * 100_000, " \n\t", "日本語 <|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r.n_tokens for r in with_sizes(df, ["doc_id"]).collect()}
    assert got == {i: len(encoding(VOCABULARY).encode_ordinary(t)) for i, t in enumerate(texts) if t}
