import re

import pytest

import __spark_entry__
from readloom import plans
from readloom.plans.masking import one
from tests.oracle import DATA, compare

CORE = {n: (q, m.ORACLE.get(n)) for m in plans.modules() for n, q in m.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in CORE.items() if sql))
def test_query_matches_sql(spark, name):
    compare(spark, *CORE[name])


def reads_by_name(spark):
    return {r.name: r for r in one(spark, DATA).collect()}


def ranges_inside(rows, reads, start, stop):
    """One row a read, its range within the read."""
    assert sorted(r.name for r in rows) == sorted(reads)
    assert all(0 <= r[start] <= r[stop] <= len(reads[r.name].seq) for r in rows)
    return {r.name: (r[start], r[stop]) for r in rows}


def check_strict_window(rows, reads):
    """Every full window of the kept range, but for the one with the base at which it ends, has the mean quality, and its edge bases have the quality."""
    for name, (a, b) in ranges_inside(rows, reads, "q_start", "q_stop").items():
        q = list(reads[name].qual)
        assert a == b or (q[a] >= 25 and q[b - 1] >= 25)
        assert all(sum(q[i : i + 20]) >= 500 for i in range(a, b - 20))


def check_poly(rows, reads):
    """What is left has at least 50 bases and no run of ten A or T within 25 bases of an end of the read that was not cut there."""
    for name, (a, b) in ranges_inside(rows, reads, "start", "stop").items():
        s = reads[name].seq.upper()
        assert (a, b) == (0, 0) or b - a >= 50
        if (a, b) != (0, 0):
            assert not any(re.match("A{10}|T{10}", s[i:b]) for i in range(a, min(a + 1, b))), name


def check_prepared(rows, reads):
    assert sorted(r.name for r in rows) == sorted(reads)
    assert {r.status for r in rows} <= {"kept", "n", "quality", "linker", "poly", "simple"} and any(r.status == "kept" for r in rows)
    for r in rows:
        assert (r.seq != "") == (r.status == "kept") and r.seq in reads[r.name].seq.upper() and (not r.seq or len(r.seq) >= 50)


def check_pieces(rows, reads):
    """Pieces are apart and cover every base of quality 30 or more that is no N."""
    held = {}
    for r in rows:
        held.setdefault(r.name, []).append((r.start, r.stop))
    for name, read in reads.items():
        pieces = sorted(held.get(name, []))
        assert all(a < b for a, b in pieces) and all(x[1] < y[0] for x, y in zip(pieces, pieces[1:], strict=False))
        assert not pieces or (pieces[0][0] >= 0 and pieces[-1][1] <= len(read.seq))
        if read.seq and min(read.qual) >= 30 and "N" not in read.seq:
            assert pieces == [(0, len(read.seq))]


def check_mended(rows, reads):
    """Only lengths of the mended lists are given: never fewer values than there were numbers left in the text."""
    assert sorted(r.name for r in rows) == sorted(reads)
    assert all(len(reads[r.name].qual) - len(reads[r.name].qual) // 24 <= r.n <= 2 * len(reads[r.name].qual) for r in rows)


def check_repaired(rows, reads):
    assert sorted(r.query_id for r in rows) == sorted(n for n, r in reads.items() if r.seq)
    for r in rows:
        old = reads[r.query_id].seq
        assert (r.seq == old) if not r.n_changes else (abs(len(r.seq) - len(old)) <= 40 * r.n_changes and r.seq != old) and 0 <= r.n_confirmed


def check_traces(rows, reads):
    assert sorted(r.name for r in rows) == sorted(reads)
    assert all(r.value.startswith("<trace>\n<CENTER_NAME>X</CENTER_NAME>\n") and f"<TRACE_NAME>{r.name}</TRACE_NAME>\n" in r.value and r.value.endswith("</trace>\n") for r in rows)


def check_reduced(rows, reads):
    """A read goes once, and never for itself."""
    assert len({r[0] for r in rows}) == len(rows) and all(r[0] != r[1] for r in rows)


WITHOUT_SQL = {
    "strict_window_clip": check_strict_window, "poly_trim": check_poly, "i4_prepared_reads": check_prepared, "w8_target_pieces": check_pieces, "f25_mended_qualities": check_mended,
    "i1_repaired_reads": check_repaired, "s18_trace_descriptions": check_traces, "i3_reduce_repeated": check_reduced,
}


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in CORE.items() if not sql))
def test_query_without_sql(spark, name):
    rows = CORE[name][0](spark, DATA).collect()
    if name == "r7_packed_files":
        bins = [sum(r.n_bases for r in rows if r.bin == i) for i in range(4)]
        assert len({r.file for r in rows}) == len(rows) > 4 and max(bins) - min(bins) <= max(r.n_bases for r in rows)
    elif name == "pair_insert_matches":
        assert rows and all(r.n > 0 for r in rows)
    else:
        WITHOUT_SQL[name](rows, reads_by_name(spark))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
