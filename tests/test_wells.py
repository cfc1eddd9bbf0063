"""The grid of wells on odd holes, and without a join."""

from statistics import mean, pstdev

import pytest

from readloom.operators import stats as S

ROWS = "hole_number bigint, length bigint, passes int"


def expected(data):
    held = {}
    for h, n, p in data:
        held.setdefault(h, []).append((n, p))
    g = {h: (max(n for n, _ in x), sum(n for n, _ in x), max(p for _, p in x)) for h, x in held.items()}
    known = [h for h in g if h is not None]
    if not known:
        return []
    totals = [x[1] for x in g.values()]
    norm = mean(totals) + 2 * pstdev(totals)
    grid = [(r, c, *g.get(r << 16 | c, (0, 0, 0))) for r in range(max(h >> 16 for h in known) + 1) for c in range(max(h & 65535 for h in known) + 1)]
    return [(*x, pytest.approx(min(1.0, x[3] / norm), abs=1e-6)) for x in grid]


@pytest.mark.parametrize(
    "holes",
    [[0, 0, 5, 3 << 16, (3 << 16) + 7], [(2 << 16) + 2], [9], [0], [None, 4, -3 & ~65535, 1 << 16], [-(1 << 16), -(2 << 16)], [None], []],
    ids=["rows without holes", "one hole", "last column", "one well", "null and negative", "negative alone", "null alone", "no rows"],
)
def test_wells_against_plain_grid(spark, holes):
    data = [(h, 100 + 37 * i % 90, i % 5) for i, h in enumerate(holes)]
    df = S.well_sizes(spark.createDataFrame(data, ROWS), cells=8)
    assert sorted(map(tuple, df.collect())) == expected(data)
    assert [t for _, t in df.dtypes] == ["bigint", "bigint", "bigint", "bigint", "int", "double"]


def test_wells_are_filled_in_parts_without_a_join(spark):
    data = [((r << 16) + 99, 10, 1) for r in range(60)]
    df = S.well_sizes(spark.createDataFrame(data, ROWS), cells=600)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    parts = [x for x in df.rdd.mapPartitions(lambda b: [sum(1 for _ in b)]).collect() if x]
    assert sum(parts) == 6000 and len(parts) > 4 and max(parts) < 3000
